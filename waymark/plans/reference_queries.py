"""Queries for the curation, splitting, retrieval and scoring operators over whole tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, text, urls, vectors
from waymark.operators import losses, pages, places, query_sets, ranking, relational, samplers, splits
from waymark.operators.packed import explode_packed
from waymark.plans.data_problems import canonical_tags
from waymark.runtime import bounded_rows, bounded_table, cut_lineage, join_counted, scratch, table
from waymark.sources import readers, writers
from waymark.streaming import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BEST = 101
_MD5 = "md5('42|' || CAST({} AS VARCHAR))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _label(c: str):
    return F.lower(F.trim(c))


# ---- retrieval -----------------------------------------------------------------------------------------------------

_KNN = f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_dot_product(q.e, v.e), 6) AS score, q.label AS ql, v.label AS vl FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    knn AS (SELECT * FROM r WHERE rank <= {BEST})"""


def _knn(spark: SparkSession, sf_dir: str, k: int = BEST) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ranking.knn(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, k)


def _query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same label, not the query itself."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return _query_ids(spark, sf_dir).join(e, "label").where("vec_id <> query_id").select("query_id", "vec_id")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places_ = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("continent"))
    e = table(spark, sf_dir, "embeddings")
    return e.join(F.broadcast(places_), F.pmod(e.vec_id, F.lit(25)) == F.col("n_nationkey")).select("vec_id", F.col("label").cast("string").alias("category"), "country", "continent")


_META = "meta AS (SELECT vec_id, CAST(label AS VARCHAR) AS category, n_name AS country, r_name AS continent FROM embeddings JOIN nation ON vec_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(_KNN + " SELECT query_id, rank, vec_id, score FROM knn")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_KNN + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, vec_id, score FROM knn WHERE vec_id <> query_id")
def knn_topk_self_removed(spark, sf_dir):
    return ranking.without_self(_knn(spark, sf_dir))


_METRICS = (
    _KNN
    + """,
    w AS (SELECT query_id, vec_id, ql, ql = vl AS hit, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rk FROM knn WHERE vec_id <> query_id),
    p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rk) / rk AS prec FROM w),
    rel AS (SELECT q.vec_id AS query_id, q.label, count(*) AS r FROM q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id GROUP BY 1, 2),
    ks AS (SELECT unnest([5, 10, 25, 50, 100]) AS k),
    per AS (SELECT rel.query_id, rel.label, ks.k, coalesce(sum(CASE WHEN hit AND rk <= k THEN prec END), 0) / least(max(r), k) AS ap, count(CASE WHEN hit AND rk <= k THEN 1 END) / max(r) AS recall
            FROM rel CROSS JOIN ks LEFT JOIN p ON p.query_id = rel.query_id GROUP BY 1, 2, 3)"""
)


def _per_query(spark, sf_dir) -> DataFrame:
    return ranking.per_query_metrics(_query_ids(spark, sf_dir), ranking.without_self(_knn(spark, sf_dir)), _relevant(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(_METRICS + " SELECT 'mAP' AS metric, k, round(avg(ap), 9) AS value FROM per GROUP BY k UNION ALL SELECT 'Recall', k, round(avg(recall), 9) FROM per GROUP BY k")
def map_recall_at_k(spark, sf_dir):
    return _rounded(ranking.mean_metrics(_per_query(spark, sf_dir)), "value")


@query(_METRICS + " SELECT label, 'mAP' AS metric, k, round(avg(ap), 9) AS value FROM per GROUP BY label, k UNION ALL SELECT label, 'Recall', k, round(avg(recall), 9) FROM per GROUP BY label, k")
def map_by_label(spark, sf_dir):
    per = _per_query(spark, sf_dir).join(_query_ids(spark, sf_dir), "query_id")
    return _rounded(ranking.mean_metrics(per, ["label"]), "value")


@query(
    _METRICS
    + """, m AS (SELECT per.*, r_name FROM per JOIN nation ON query_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'country' AS slice_type, n_name AS slice_key, k, round(avg(ap), 9) AS map FROM per JOIN nation ON query_id % 25 = n_nationkey GROUP BY 2, 3
    UNION ALL SELECT 'region', r_name, k, round(avg(ap), 9) FROM m GROUP BY 2, 3"""
)
def map_by_place(spark, sf_dir):
    """Slices by country and region from one scored table."""
    meta = _meta(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "country", F.col("continent").alias("region"))
    per = cut_lineage(_per_query(spark, sf_dir).join(meta, "query_id"))
    one = lambda c: ranking.mean_metrics(per.where(F.coalesce(c, F.lit("")) != ""), [c]).where("metric = 'mAP'").select(F.lit(c).alias("slice_type"), F.col(c).alias("slice_key"), "k", F.round("value", 9).alias("map"))
    return one("country").unionByName(one("region"))


@query(_KNN + " SELECT query_id, count(CASE WHEN ql = vl THEN 1 END) AS hits FROM knn WHERE rank <= 5 GROUP BY query_id")
def topk_hits_of_k(spark, sf_dir):
    top = _knn(spark, sf_dir, 5).join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("vl")), "vec_id").join(_query_ids(spark, sf_dir), "query_id")
    return top.groupBy("query_id").agg(F.count_if(F.col("vl") == F.col("label")).alias("hits"))


@query(
    """
    WITH q AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, a.label AS ql, b.label AS vl, b.vec_id AS vec_id, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN q ON q.vec_id = a.vec_id, v b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s),
    p AS (SELECT *, sum((ql = vl)::INT) OVER (PARTITION BY query_id ORDER BY rk) / rk AS prec FROM r WHERE rk <= 101),
    n AS (SELECT label, count(*) AS r FROM embeddings GROUP BY label HAVING count(*) >= 5)
    SELECT n.label, round(sum(CASE WHEN ql = vl AND rk <= 10 THEN prec ELSE 0 END) / least(max(r), 10), 9) AS map_10, round(count(CASE WHEN ql = vl AND rk <= 100 THEN 1 END) / max(r), 9) AS recall_100
    FROM n JOIN p ON p.ql = n.label GROUP BY n.label"""
)
def marginal_scores(spark, sf_dir):
    """A query per label, its relevant items all of the label; the label's first vector stands for the encoded text."""
    e = table(spark, sf_dir, "embeddings")
    heads = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.count("*").alias("n")).where("n >= 5").select(F.col("label").cast("bigint").alias("query_id"), "embedding")
    relevant = e.select(F.col("label").cast("bigint").alias("query_id"), "vec_id")
    per = ranking.per_query_metrics(heads, ranking.knn(heads, e, BEST), relevant)
    return per.select(F.col("query_id").cast("int").alias("label"), F.round("ap_10", 9).alias("map_10"), F.round("recall_100", 9).alias("recall_100"))


_MINED = _KNN.replace("<= 101", "<= 201") + f", {_META}, mined AS (SELECT knn.query_id, knn.vec_id, knn.rank, knn.score, m.category, m.country, m.continent, f.country AS ref_country, f.continent AS ref_continent FROM knn JOIN meta m USING (vec_id) JOIN meta f ON f.vec_id = query_id WHERE knn.vec_id <> query_id AND score < 0.95 AND m.category = f.category AND m.country <> f.country)"


def _mined(spark, sf_dir) -> DataFrame:
    return query_sets.mined_targets(_knn(spark, sf_dir, 201), _meta(spark, sf_dir))


@query(_MINED + " SELECT query_id, vec_id, rank, score, country, continent FROM mined")
def knn_constrained_mining(spark, sf_dir):
    return _mined(spark, sf_dir).select("query_id", "vec_id", "rank", "score", "country", "continent")


_COMPOSED = " SELECT 'sub_' || query_id || '_q_' || query_id || '_{m}_' || {g} AS query_id, '{g}' AS granularity, 'similar landmark located in ' || {g} AS caption, query_id AS ref_id, array_to_string(list_sort(list(vec_id)), ',') AS target_ids FROM mined {w} GROUP BY query_id, {g}"


@query(_MINED.replace("mined AS", "mined AS") + _COMPOSED.format(m="c1", g="country", w=""))
def composed_queries_country(spark, sf_dir):
    return writers.flat_lists(query_sets.composed_queries(_mined(spark, sf_dir), "country"))


@query(_MINED + _COMPOSED.format(m="c2", g="continent", w="WHERE continent <> ref_continent"))
def composed_queries_continent(spark, sf_dir):
    return writers.flat_lists(query_sets.composed_queries(_mined(spark, sf_dir), "continent"))


_CENTROID = "c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)"


@query(f"WITH {_CENTROID} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(m, 9) AS value FROM c")
def centroids(spark, sf_dir):
    c = ranking.centroids(table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", F.posexplode("embedding").alias("pos", "v")).select("label", "pos", F.round("v", 9).alias("value"))


@query(f"WITH {_CENTROID}, l AS (SELECT label, list(m ORDER BY i) AS e FROM c GROUP BY label), s AS (SELECT vec_id, l.label AS nearest, round(list_dot_product(CAST(embedding AS DOUBLE[]), l.e), 6) AS score FROM embeddings, l) SELECT vec_id, nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) = 1")
def nearest_centroid(spark, sf_dir):
    """Every vector to its nearest centroid."""
    e = table(spark, sf_dir, "embeddings")
    return ranking.nearest_centre(e, ranking.centroids(e, "label"), "vec_id", "label").withColumn("nearest", F.col("nearest").cast("int"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm_before, 1.0 AS norm_after FROM embeddings")
def l2_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm_before"), F.round(vectors.norm(vectors.l2_normalise(F.col("embedding"))), 6).alias("norm_after"))


@query(
    """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT a.vec_id, a.e AS v, b.e AS t FROM p a JOIN p b ON b.vec_id = CASE WHEN a.vec_id + 1 < (SELECT count(*) FROM p) THEN a.vec_id + 1 ELSE 0 END)
    SELECT vec_id, round(2 * list_dot_product(v, t) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(t, t)) / sqrt(6), 6) AS score FROM n"""
)
def composite_vector_score(spark, sf_dir):
    """Image [v, v, v] against text [t, t, 0], where t is the next vector: (2 v.t)/sqrt(6)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    following = e.select((F.col("vec_id") - 1).alias("before"), F.col("embedding").alias("t"))
    last = following.crossJoin(F.broadcast(n)).select(F.when(F.col("before") < 0, F.col("n") - 1).otherwise(F.col("before")).alias("vec_id"), "t")
    both = e.join(last, "vec_id")
    image = vectors.image_vector(F.col("embedding"), F.col("embedding"), F.col("embedding"))
    query_vector = vectors.text_vector(F.col("t"), F.col("t"), 64)
    return both.select("vec_id", F.round(vectors.dot(image, query_vector), 6).alias("score"))


@query(_KNN + ", z AS (SELECT query_id, vec_id, rank, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.01) AS x FROM knn) SELECT query_id, vec_id, round(x / sum(x) OVER (PARTITION BY query_id), 9) AS probability FROM z QUALIFY rank <= 5")
def softmax_topk(spark, sf_dir):
    """Probabilities over the retrieved gallery at a temperature below the least, which is taken instead; the best five."""
    t = vectors.temperature(F.lit(0.001))
    w = Window.partitionBy("query_id")
    z = _knn(spark, sf_dir).withColumn("x", F.exp((F.col("score") - F.max("score").over(w)) / t))
    return z.withColumn("probability", F.round(F.col("x") / F.sum("x").over(w), 9)).where("rank <= 5").select("query_id", "vec_id", "probability")


# ---- batches and losses --------------------------------------------------------------------------------------------

_POOL = "pool AS (SELECT row_idx, lower(trim(category, ' ')) AS category, lower(trim(country, ' ')) AS country, id, landmark_id, continent, subregion, confidence FROM image_pool WHERE category IS NOT NULL AND country IS NOT NULL)"


def _pool(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "image_pool").where("category is not null and country is not null")
    return p.withColumns({"category": _label("category"), "country": _label("country")})


@query(f"WITH {_POOL}, c AS (SELECT category, country, count(*) AS n FROM pool GROUP BY 1, 2), w AS (SELECT *, (1 - 0.999) / (1 - pow(0.999, n)) AS w FROM c) SELECT category, country, n, round(w / (SELECT avg(w) FROM w), 9) AS weight FROM w")
def class_balanced_weights(spark, sf_dir):
    return _rounded(samplers.class_weights(_pool(spark, sf_dir), ["category", "country"], 0.999), "weight")


@query(f"WITH {_POOL} SELECT category, country, dense_rank() OVER (ORDER BY category, country) - 1 AS cell_id FROM (SELECT DISTINCT category, country FROM pool)")
def cell_ids(spark, sf_dir):
    return relational.cell_ids(_pool(spark, sf_dir), ["category", "country"]).withColumn("cell_id", F.col("cell_id").cast("bigint"))


def _batched(spark, sf_dir) -> DataFrame:
    """Vectors in batches of 32 by id; the cell is the label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("vec_id").alias("i"), F.col("label").alias("cell"), F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))


_BATCH = "e AS (SELECT vec_id // 32 AS batch, vec_id AS i, label AS cell, CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings), p AS (SELECT x.batch, x.i, y.i AS j, x.cell = y.cell AND x.i <> y.i AS pos, list_dot_product(x.a, y.b) / 0.1 AS ab, list_dot_product(x.b, y.a) / 0.1 AS ba FROM e x JOIN e y ON x.batch = y.batch)"


@query(f"WITH {_BATCH} SELECT batch, count(CASE WHEN pos THEN 1 END) AS positives, count(*) AS pairs FROM p GROUP BY batch")
def positive_mask_counts(spark, sf_dir):
    return losses.batch_pairs(_batched(spark, sf_dir)).groupBy("batch").agg(F.count_if("positive").alias("positives"), F.count("*").alias("pairs"))


@query(f"WITH {_BATCH}, n AS (SELECT batch, i, count(CASE WHEN pos THEN 1 END) AS n, ln(sum(exp(ab - 10))) + 10 AS la, ln(sum(exp(ba - 10))) + 10 AS lb, sum(CASE WHEN pos THEN ab END) AS sa, sum(CASE WHEN pos THEN ba END) AS sb FROM p GROUP BY 1, 2) SELECT batch, round((coalesce(avg(CASE WHEN n > 0 THEN la - sa / n END), 0) + coalesce(avg(CASE WHEN n > 0 THEN lb - sb / n END), 0)) / 2, 6) AS loss FROM n GROUP BY batch")
def infonce_loss(spark, sf_dir):
    return _rounded(losses.multi_positive_infonce(losses.batch_pairs(_batched(spark, sf_dir)), 0.1), "loss", digits=6)


@query(f"WITH {_BATCH}, n AS (SELECT batch, i, ln(sum(exp(ab - 10))) + 10 AS la, ln(sum(exp(ba - 10))) + 10 AS lb, sum(CASE WHEN i = j THEN ab END) AS sa, sum(CASE WHEN i = j THEN ba END) AS sb FROM p GROUP BY 1, 2) SELECT batch, round((avg(la - sa) + avg(lb - sb)) / 2, 6) AS loss FROM n GROUP BY batch")
def cross_entropy_loss(spark, sf_dir):
    return _rounded(losses.cross_entropy(losses.batch_pairs(_batched(spark, sf_dir)), 0.1), "loss", digits=6)


_CELL_ORDER = "md5('0|{\"category\":\"' || category || '\",\"country\":\"' || country || '\"}'), category, country"


@query(f"""WITH {_POOL}, r AS (SELECT row_idx, category, country, row_number() OVER (PARTITION BY category, country ORDER BY md5('0|' || CAST(row_idx AS VARCHAR)), row_idx) - 1 AS r FROM pool),
    p AS (SELECT category, country, r // 2 AS pair, arg_min(row_idx, r) AS first, arg_max(row_idx, r) AS second FROM r GROUP BY 1, 2, 3 HAVING count(*) = 2 AND r // 2 < 1157),
    n AS (SELECT *, row_number() OVER (ORDER BY pair, {_CELL_ORDER}) - 1 AS pos, count(*) OVER () AS t FROM p) SELECT pos // 32 AS batch, pos, first, second FROM n WHERE pos // 32 < t // 32""")
def pair_batches(spark, sf_dir):
    return samplers.pair_batches(_pool(spark, sf_dir), "row_idx", ["category", "country"], 64)


@query(f"""WITH {_POOL}, r AS (SELECT row_idx, category, country, row_number() OVER (PARTITION BY category, country ORDER BY md5('0|' || CAST(row_idx AS VARCHAR)), row_idx) - 1 AS r, count(*) OVER (PARTITION BY category, country) AS size FROM pool),
    d AS (SELECT category, country, size, unnest(range(greatest(1, least(size, 500) // 4))) AS draw FROM (SELECT DISTINCT category, country, size FROM r WHERE size >= 2)),
    s AS (SELECT *, row_number() OVER (ORDER BY draw, {_CELL_ORDER}) - 1 AS slot, count(*) OVER () AS t FROM d),
    j AS (SELECT *, unnest([0, 1, 2, 3]) AS j FROM s WHERE slot // 16 < t // 16)
    SELECT slot // 16 AS batch, slot, j.j, r.row_idx AS item FROM j JOIN r ON r.category = j.category AND r.country = j.country AND r.r = (j.draw * 4 + j.j) % j.size""")
def pk_batches(spark, sf_dir):
    return samplers.pk_batches(_pool(spark, sf_dir), "row_idx", ["category", "country"], 64, 4, cap=500)


# ---- query sets ----------------------------------------------------------------------------------------------------


def _built(granularity: str, place: str, text_sql: str) -> str:
    return f"WITH p AS (SELECT row_idx, lower(trim(category, ' ')) AS category, trim({place}, ' ') AS geo FROM image_pool WHERE category IS NOT NULL AND {place} IS NOT NULL) SELECT category || '|' || geo AS stratify_key, {text_sql} AS text, category, geo, '{granularity}' AS granularity, array_to_string(list_sort(list(row_idx)), ',') AS relevant FROM p GROUP BY category, geo HAVING count(*) >= 5"


def _build(spark, sf_dir, granularity: str, place: str) -> DataFrame:
    p = table(spark, sf_dir, "image_pool").select("row_idx", _label("category").alias("category"), F.trim(place).alias("place"))
    return writers.flat_lists(query_sets.build_queries(p, granularity, "place"))


@query(_built("country", "country", "'A ' || category || ' landmark located in ' || geo"))
def build_queries_country(spark, sf_dir):
    return _build(spark, sf_dir, "country", "country")


@query(_built("region", "continent", "'A ' || category || ' landmark located in the ' || geo || ' region'"))
def build_queries_region(spark, sf_dir):
    return _build(spark, sf_dir, "region", "continent")


@query(_built("subregion", "subregion", "'A ' || category || ' landmark located in ' || geo"))
def build_queries_subregion(spark, sf_dir):
    return _build(spark, sf_dir, "subregion", "subregion")


@query("WITH p AS (SELECT row_idx, lower(trim(category, ' ')) AS category, trim(country, ' ') AS geo FROM image_pool WHERE category IS NOT NULL AND country IS NOT NULL), g AS (SELECT *, count(*) OVER (PARTITION BY category, geo) AS n_relevant FROM p) SELECT category || '|' || geo AS stratify_key, 'A ' || category || ' landmark located in ' || geo AS text, category, geo, 'country' AS granularity, n_relevant, row_idx FROM g WHERE n_relevant >= 5")
def query_ground_truth(spark, sf_dir):
    """The same queries with one row per relevant row, which has no bound."""
    p = table(spark, sf_dir, "image_pool").select("row_idx", _label("category").alias("category"), F.trim("country").alias("place"))
    return query_sets.ground_truth(p, "country", "place")


_CITY = "city AS (SELECT id, min(city) AS city FROM reverse_geocode WHERE city IS NOT NULL GROUP BY id)"


@query(f"WITH {_CITY}, p AS (SELECT row_idx, lower(trim(category, ' ')) AS category, city.city AS geo FROM image_pool JOIN city USING (id) WHERE category IS NOT NULL) SELECT category || '|' || geo AS stratify_key, 'A ' || category || ' landmark located in the city of ' || geo AS text, category, geo, 'city' AS granularity, array_to_string(list_sort(list(row_idx)), ',') AS relevant FROM p GROUP BY category, geo HAVING count(*) >= 5")
def build_queries_city(spark, sf_dir):
    city = table(spark, sf_dir, "reverse_geocode").where("city is not null").groupBy("id").agg(F.min("city").alias("city"))
    p = table(spark, sf_dir, "image_pool").join(city, "id").select("row_idx", _label("category").alias("category"), "city")
    return writers.flat_lists(query_sets.build_queries(p, "city", "city"))


@query(f"WITH {_POOL} SELECT category, country, arg_min(continent, row_idx) AS region, count(*) AS n, array_to_string(list_sort(list(row_idx)), ',') AS relevant FROM pool WHERE continent IS NOT NULL GROUP BY 1, 2")
def build_queries_with_region(spark, sf_dir):
    """The variant that carries the group's first region and applies no threshold."""
    p = query_sets.short_groups(_pool(spark, sf_dir).where("continent is not null"), ["category", "country"])
    g = p.groupBy("category", "country").agg(F.min_by("continent", "row_idx").alias("region"), F.count("*").alias("n"), F.sort_array(F.collect_list("row_idx")).alias("relevant"))
    return writers.flat_lists(g)


@query("WITH p AS (SELECT trim(country, ' ') AS key FROM image_pool WHERE coalesce(trim(country, ' '), '') <> '') SELECT key, 'a landmark located in ' || key AS text, count(*) AS n_relevant FROM p GROUP BY key HAVING count(*) >= 5 UNION ALL SELECT lower(trim(category, ' ')) AS key, 'a ' || key, count(*) FROM image_pool WHERE coalesce(category, '') <> '' GROUP BY 1 HAVING count(*) >= 5")
def marginal_queries(spark, sf_dir):
    p = table(spark, sf_dir, "image_pool").select("row_idx", F.trim("country").alias("country"), _label("category").alias("category"))
    return query_sets.marginal_queries(p, "country", "a landmark located in %s", "row_idx").unionByName(query_sets.marginal_queries(p, "category", "a %s", "row_idx"))


@query("WITH c AS (SELECT DISTINCT human_tag_parent AS category FROM tag_cluster WHERE human_tag_parent IS NOT NULL), t AS (SELECT lower(trim(category, ' ')) AS category, trim(country, ' ') AS country, array_to_string(list_sort(list(row_idx)), ',') AS relevant FROM image_pool GROUP BY 1, 2) SELECT 'a ' || c.category || ' located in ' || k.country AS text, c.category, k.country AS raw_country, k.country, k.region, coalesce(t.relevant, '') AS relevant FROM country_table k CROSS JOIN c LEFT JOIN t ON t.category = c.category AND t.country = k.country")
def templated_grid_ground_truth(spark, sf_dir):
    categories = table(spark, sf_dir, "tag_cluster").where("human_tag_parent is not null").select(F.col("human_tag_parent").alias("category")).distinct()
    rows = table(spark, sf_dir, "image_pool").select("row_idx", _label("category").alias("category"), F.trim("country").alias("country"))
    return writers.flat_lists(query_sets.templated_grid(table(spark, sf_dir, "country_table"), categories, rows, "row_idx"))


@query(f"WITH {_POOL}, q AS (SELECT category, country AS geo, count(*) AS n FROM pool GROUP BY 1, 2 HAVING count(*) >= 5) SELECT category, geo, n, unnest(['photo of a ' || category || ' in ' || geo, geo || ': ' || category, category || ', ' || geo]) AS text FROM q")
def augmented_fanout(spark, sf_dir):
    q = _pool(spark, sf_dir).groupBy("category", F.col("country").alias("geo")).agg(F.count("*").alias("n")).where("n >= 5").withColumn("text", F.lit(""))
    variants = q.select("category", "geo", F.array(F.concat(F.lit("photo of a "), "category", F.lit(" in "), "geo"), F.concat("geo", F.lit(": "), "category"), F.concat_ws(", ", "category", "geo")).alias("variants"))
    return query_sets.fan_out(q, variants, ["category", "geo"], "variants")


@query("WITH d AS (SELECT DISTINCT lower(regexp_extract(lower(id), '([0-9a-f]{16})', 1)) AS image, lower(trim(pred_label, ' ')) AS category, trim(country, ' ') AS country FROM datasplit WHERE pred_label IS NOT NULL AND country IS NOT NULL), r AS (SELECT id AS image, min(row_idx) AS row_idx FROM image_pool GROUP BY id) SELECT category || '|' || country AS query_id, count(row_idx) AS n_found, count(*) - count(row_idx) AS n_missing, count(row_idx) >= 5 AS kept FROM d LEFT JOIN r USING (image) GROUP BY category, country")
def relevance_translate_missing(spark, sf_dir):
    """Image ids of each (label, country) looked up in the index; misses are counted and don't help the minimum."""
    image = F.regexp_extract(F.lower("id"), "([0-9a-f]{16})", 1)
    d = table(spark, sf_dir, "datasplit").where("pred_label is not null and country is not null").select(image.alias("image"), F.concat_ws("|", _label("pred_label"), F.trim("country")).alias("query_id")).distinct()
    items = table(spark, sf_dir, "image_pool").groupBy(F.col("id").alias("image")).agg(F.min("row_idx").alias("row_idx"))
    return query_sets.usable_queries(query_sets.translate(d, items, "image", "row_idx"), "row_idx", 5)


# ---- counts, shares, pivots ----------------------------------------------------------------------------------------


@query("SELECT country, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM datasplit GROUP BY country")
def count_share(spark, sf_dir):
    return relational.shares(table(spark, sf_dir, "datasplit"), ["country"])


@query("WITH c AS (SELECT country, count(*) AS n FROM datasplit GROUP BY country) SELECT country, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY n DESC, country NULLS FIRST ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cum_share FROM c")
def count_cumshare(spark, sf_dir):
    return relational.cumulative_shares(table(spark, sf_dir, "datasplit"), "country").drop("number")


@query("SELECT src, split, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM datasplit GROUP BY src, split")
def share_in_group(spark, sf_dir):
    return relational.shares(table(spark, sf_dir, "datasplit"), ["src", "split"], ["src"])


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) / count(*) OVER () AS rank_share, sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS coverage FROM c")
def coverage_curve(spark, sf_dir):
    c = relational.cumulative_shares(table(spark, sf_dir, "events"), "event_type")
    values = c.agg(F.count("*").alias("values"))
    return c.crossJoin(F.broadcast(values)).select("event_type", "n", (F.col("number") / F.col("values")).alias("rank_share"), F.col("cum_share").alias("coverage"))


@query("WITH t AS (SELECT country FROM idk2 WHERE country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 5) PIVOT (SELECT CASE WHEN country IN (SELECT country FROM t) THEN country ELSE 'Other' END AS grp, lower(trim(pred_label, ' ')) AS label FROM idk2) ON grp USING count(*) GROUP BY label")
def pivot_top_plus_other(spark, sf_dir):
    """Rows of every label, null too, by the most frequent countries and Other as columns."""
    d = table(spark, sf_dir, "idk2").select("country", _label("pred_label").alias("label"))
    top = relational.top_values(d, "country", 5)
    return relational.pivot_counts(d.select(relational.top_or_other("country", top).alias("grp"), "label"), "label", "grp", list(dict.fromkeys([*top, "Other"])))


@query("SELECT l_returnflag, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS F, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS O, count(CASE WHEN l_linestatus IN ('F', 'O') THEN 1 END) AS total FROM lineitem GROUP BY l_returnflag")
def pivot_matrix_total(spark, sf_dir):
    """Row totals over the pivoted columns, which come in the order of their sums."""
    d = table(spark, sf_dir, "lineitem")
    labels = relational.counts(d.where("l_linestatus is not null"), "l_linestatus").orderBy(F.col("n").desc(), "l_linestatus")
    order = [r[0] for r in bounded_rows(labels, 1000, "the list of pivot columns")]
    wide = relational.pivot_counts(d, "l_returnflag", "l_linestatus", order)
    return wide.withColumn("total", sum((F.col(c) for c in order), F.lit(0).cast("bigint")))


@query("WITH u AS (SELECT landmark_id, count(DISTINCT country) + max((country IS NULL)::INT) AS n_countries FROM datasplit GROUP BY landmark_id) SELECT n_countries, count(*) AS landmarks FROM u GROUP BY n_countries")
def two_level_distribution(spark, sf_dir):
    per = table(spark, sf_dir, "datasplit").groupBy("landmark_id").agg(relational.distinct_count("country").alias("n_countries"))
    return per.groupBy("n_countries").agg(F.count("*").alias("landmarks"))


_CELLS = "c AS (SELECT country, lower(trim(pred_label, ' ')) AS label, count(DISTINCT wikimedia_url) AS w, count(*) AS n FROM datasplit WHERE country IS NOT NULL AND pred_label IS NOT NULL GROUP BY 1, 2)"


def _cells(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "datasplit").where("country is not null and pred_label is not null")
    return d.groupBy("country", _label("pred_label").alias("label")).agg(F.count_distinct("wikimedia_url").alias("w"), F.count("*").alias("n"))


@query(f"WITH {_CELLS} SELECT CASE WHEN w = 1 THEN 'W=1' WHEN w = 2 THEN 'W=2' WHEN w < 7 THEN 'W 3-6' WHEN w < 20 THEN 'W 7-19' ELSE 'W>=20' END AS tier, count(*) AS cells, CAST(sum(w) AS BIGINT) AS urls, CAST(sum(n) AS BIGINT) AS images FROM c GROUP BY 1")
def tier_labels(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("tier", text.tier(F.col("w")))
    return c.groupBy("tier").agg(F.count("*").alias("cells"), F.sum("w").alias("urls"), F.sum("n").alias("images"))


@query(f"WITH {_CELLS} SELECT min(n) AS least, quantile_disc(n, 0.25) AS nearest_25, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, max(n) AS most, avg(n) AS mean FROM c".replace("quantile_disc(n, 0.25)", "(SELECT list(n ORDER BY n)[CAST(round_even(0.25 * (count(*) - 1), 0) AS INTEGER) + 1] FROM c)"))
def cell_quantiles(spark, sf_dir):
    """Nearest-rank and interpolated quantiles side by side, named for what they are."""
    c = _cells(spark, sf_dir)
    nearest = relational.nearest_quantile(c, "n", 0.25).select(F.col("value").alias("nearest_25"))
    rest = c.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.25)).alias("p25"), F.median("n").alias("p50"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return rest.crossJoin(F.broadcast(nearest)).select("least", "nearest_25", "p25", "p50", "p90", "most", "mean")


@query("SELECT src, count(DISTINCT country) + max((country IS NULL)::INT) AS countries, count(DISTINCT country) AS named, count(CASE WHEN country IS NULL THEN 1 END) AS missing, count(CASE WHEN pred_label = 'crossing' THEN 1 END) AS crossings FROM datasplit GROUP BY src")
def distinct_with_null(spark, sf_dir):
    d = table(spark, sf_dir, "datasplit")
    return d.groupBy("src").agg(relational.distinct_count("country").alias("countries"), F.count_distinct("country").alias("named"), F.count_if(F.col("country").isNull()).alias("missing"), F.count_if(F.col("pred_label") == "crossing").alias("crossings"))


@query("SELECT region, country, n, rk FROM (SELECT region, country, count(*) AS n, dense_rank() OVER (PARTITION BY region ORDER BY count(*) DESC) AS rk FROM idk2 WHERE region IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2) WHERE rk <= 10 AND n >= 3")
def top_per_region_dense_rank(spark, sf_dir):
    n = relational.counts(table(spark, sf_dir, "idk2").where("region is not null and country is not null"), "region", "country")
    return n.withColumn("rk", F.dense_rank().over(Window.partitionBy("region").orderBy(F.col("n").desc()))).where("rk <= 10 and n >= 3")


@query("SELECT lang, count(*) AS n, avg(n_chars) AS mean_chars, stddev_pop(n_chars) AS std_chars, min(n_chars) AS least, max(n_chars) AS most, count(CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '')) > 77 THEN 1 END) AS over_limit FROM documents WHERE text IS NOT NULL GROUP BY lang")
def length_stats(spark, sf_dir):
    """White-space words stand for the tokens of a text encoder here; the limit is that encoder's."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    words = F.size(F.filter(F.split("text", "[ \\n\\r\\t]+"), lambda x: x != ""))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.stddev_pop("n_chars").alias("std_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(words > 77).alias("over_limit"))


@query("SELECT 'split' AS field, coalesce(split, '-') AS value, count(*) AS n FROM datasplit GROUP BY 2 UNION ALL SELECT 'null landmark_id', '-', count(*) FROM datasplit WHERE landmark_id IS NULL")
def value_and_null_counts(spark, sf_dir):
    d = table(spark, sf_dir, "datasplit")
    values = d.groupBy(F.coalesce("split", F.lit("-")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("split").alias("field"), "value", "n")
    return values.unionByName(d.agg(F.count_if(F.col("landmark_id").isNull()).alias("n")).select(F.lit("null landmark_id").alias("field"), F.lit("-").alias("value"), "n"))


@query("SELECT cluster, count(*) AS size, avg(probability) AS mean_probability, min(probability) AS least, (SELECT count(CASE WHEN cluster = -1 THEN 1 END) / count(*) FROM tag_cluster) AS noise_ratio FROM tag_cluster GROUP BY cluster")
def cluster_statistics(spark, sf_dir):
    """Cluster labels come as input: size, persistence and the share that no cluster took."""
    t = table(spark, sf_dir, "tag_cluster")
    noise = t.agg((F.count_if(F.col("cluster") == -1) / F.count("*")).alias("noise_ratio"))
    return t.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("probability").alias("mean_probability"), F.min("probability").alias("least")).crossJoin(F.broadcast(noise))


# ---- curation ------------------------------------------------------------------------------------------------------


@query("SELECT wikimedia_url, scrape_id, error FROM (SELECT *, row_number() OVER (PARTITION BY wikimedia_url ORDER BY (error IS NULL OR error = '') DESC, scraped_at DESC NULLS LAST, scrape_id DESC) AS r FROM wikidata) WHERE r = 1")
def last_success_wins(spark, sf_dir):
    return relational.last_success(table(spark, sf_dir, "wikidata"), "wikimedia_url", "error", ["scraped_at", "scrape_id"]).select("wikimedia_url", "scrape_id", "error")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf_dir):
    return relational.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


_CELL = ["country", "label"]
_SPLIT_ROWS = "d AS (SELECT row_id, wikimedia_url, country, lower(trim(pred_label, ' ')) AS label FROM datasplit WHERE wikimedia_url IS NOT NULL AND country IS NOT NULL AND pred_label IS NOT NULL)"
_HOME = _SPLIT_ROWS + ", home AS (SELECT wikimedia_url, country, label, count(*) AS n FROM d GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY wikimedia_url ORDER BY count(*) DESC, country, label) = 1)"
_URL_SPLIT = _HOME + f", k AS (SELECT *, count(*) OVER (PARTITION BY country, label) AS w, row_number() OVER (PARTITION BY country, label ORDER BY {_MD5.format('wikimedia_url')}, wikimedia_url) - 1 AS rk FROM home), q AS (SELECT *, greatest(1, round_even(0.15 * w, 0)) AS quota FROM k), s AS (SELECT wikimedia_url, country, label, n, w, CASE WHEN w < 5 THEN 'train' WHEN rk < quota THEN 'test' WHEN rk < 2 * quota THEN 'val' ELSE 'train' END AS split FROM q)"


def _split_rows(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "datasplit").where("wikimedia_url is not null and country is not null and pred_label is not null")
    return d.select("row_id", "wikimedia_url", "country", _label("pred_label").alias("label"))


def _url_split(spark, sf_dir) -> DataFrame:
    return splits.url_disjoint_split(_split_rows(spark, sf_dir), "wikimedia_url", _CELL)


@query(f"WITH {_HOME} SELECT wikimedia_url, country, label, n FROM home")
def dominant_cell_per_url(spark, sf_dir):
    return relational.dominant(_split_rows(spark, sf_dir), "wikimedia_url", _CELL)


@query(f"WITH {_URL_SPLIT} SELECT * FROM s")
def url_disjoint_split(spark, sf_dir):
    return _url_split(spark, sf_dir)


@query(f"WITH {_URL_SPLIT}, i AS (SELECT d.wikimedia_url, s.split FROM d LEFT JOIN s USING (wikimedia_url)) SELECT count(*) AS images, count(CASE WHEN split IS NULL THEN 1 END) AS without_split, (SELECT count(*) FROM (SELECT wikimedia_url FROM i GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaking_urls FROM i")
def split_leak_check(spark, sf_dir):
    i = _split_rows(spark, sf_dir).join(_url_split(spark, sf_dir).select("wikimedia_url", "split"), "wikimedia_url", "left")
    leaks = i.groupBy("wikimedia_url").agg(relational.distinct_count("split").alias("k")).where("k > 1").agg(F.count("*").alias("leaking_urls"))
    return i.agg(F.count("*").alias("images"), F.count_if(F.col("split").isNull()).alias("without_split")).crossJoin(F.broadcast(leaks))


@query(f"WITH {_URL_SPLIT}, f AS (SELECT country, label, count(DISTINCT split) AS folds FROM s GROUP BY 1, 2) SELECT folds, count(*) AS cells FROM f GROUP BY folds")
def fold_coverage(spark, sf_dir):
    f = _url_split(spark, sf_dir).groupBy(*_CELL).agg(F.count_distinct("split").alias("folds"))
    return f.groupBy("folds").agg(F.count("*").alias("cells"))


@query(f"WITH {_POOL}, r AS (SELECT row_idx, category, country, count(*) OVER w AS n, row_number() OVER (PARTITION BY category, country ORDER BY {_MD5.format('row_idx')}, row_idx) AS r FROM pool WINDOW w AS (PARTITION BY category, country)) SELECT row_idx, category, country, n >= 10 AND r <= floor(n * 0.1) AS is_test FROM r")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(_pool(spark, sf_dir).select("row_idx", "category", "country"), "row_idx", ["category", "country"])


@query(f"WITH {_POOL}, r AS (SELECT category, country, count(*) OVER (PARTITION BY category, country) AS n, row_number() OVER (PARTITION BY category, country ORDER BY {_MD5.format('row_idx')}, row_idx) AS r FROM pool), t AS (SELECT category, country, count(*) AS n, count(CASE WHEN n >= 10 AND r <= floor(n * 0.1) THEN 1 END) AS tests FROM r GROUP BY 1, 2) SELECT category, country, n, tests, tests / n AS ratio FROM t")
def split_ratios(spark, sf_dir):
    """Test rows against all rows of each cell: one aggregate with two counts rather than a join of two aggregates."""
    s = stratified_split(spark, sf_dir)
    t = s.groupBy("category", "country").agg(F.count("*").alias("n"), F.count_if("is_test").alias("tests"))
    return t.withColumn("ratio", F.col("tests") / F.col("n"))


@query("WITH u AS (SELECT row_idx, ('0x' || substr(md5('42|' || CAST(row_idx AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u FROM image_pool) SELECT row_idx, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + (1 - 0.2) * 0.1 THEN 'val' ELSE 'train' END AS split FROM u")
def random_split(spark, sf_dir):
    return splits.random_split(table(spark, sf_dir, "image_pool").select("row_idx"), "row_idx")


@query(f"WITH {_POOL}, r AS (SELECT row_idx, category, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY {_MD5.format('row_idx')}, row_idx) AS r FROM pool), q AS (SELECT *, round_even(0.2 * n, 0) AS t FROM r) SELECT row_idx, category, CASE WHEN r <= t THEN 'test' WHEN r <= t + round_even(0.3 * (n - t), 0) THEN 'val' ELSE 'train' END AS split FROM q")
def stratified_random_split(spark, sf_dir):
    """Each label's rows at random: a fifth for testing, three tenths of the rest for validation."""
    return splits.stratified_random_split(_pool(spark, sf_dir).select("row_idx", "category"), "row_idx", "category")


@query(f"SELECT row_idx, id FROM image_pool ORDER BY {_MD5.format('row_idx')}, row_idx LIMIT 100")
def sample_n(spark, sf_dir):
    return splits.sample_n(table(spark, sf_dir, "image_pool").select("row_idx", "id"), "row_idx", 100)


@query("SELECT row_idx % 4 AS shard, count(*) AS n, min(row_idx) AS least FROM image_pool GROUP BY 1")
def modulo_shard(spark, sf_dir):
    """All shards, each taken as a worker would take its own."""
    p = table(spark, sf_dir, "image_pool").select("row_idx")
    parts = [splits.shard(p, "row_idx", 4, s).agg(F.lit(s).cast("bigint").alias("shard"), F.count("*").alias("n"), F.min("row_idx").alias("least")) for s in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_POOL}, p AS (SELECT *, {_MD5.format('row_idx')} AS h FROM pool WHERE confidence >= 0.5),
    o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY category, continent, country, landmark_id ORDER BY h, row_idx) = 1),
    q AS (SELECT *, greatest(1, 1000 // (SELECT count(*) FROM (SELECT DISTINCT category, continent FROM o))) AS q, row_number() OVER (PARTITION BY category, continent, country ORDER BY h, row_idx) AS i FROM o),
    k AS (SELECT q.*, c.countries FROM q JOIN (SELECT category, continent, count(DISTINCT country) AS countries FROM o GROUP BY 1, 2) c ON c.category = q.category AND c.continent IS NOT DISTINCT FROM q.continent WHERE i <= greatest(1, q // countries)),
    j AS (SELECT *, row_number() OVER (PARTITION BY category, continent ORDER BY i, country NULLS FIRST, h, row_idx) AS j FROM k)
    SELECT row_idx, category, continent, country, landmark_id FROM j WHERE j <= q""")
def balanced_seeds(spark, sf_dir):
    p = _pool(spark, sf_dir).where("confidence >= 0.5")
    return splits.balanced_seeds(p, "row_idx", "category", "continent", "country", "landmark_id", 1000).select("row_idx", "category", "continent", "country", "landmark_id")


# ---- joins ---------------------------------------------------------------------------------------------------------

_CODES = "SELECT country, min(country_code) AS country_code FROM country_table WHERE country IS NOT NULL GROUP BY country"


@query("WITH s AS (SELECT wikimedia_url, max(poi_name) AS poi_name FROM wikidata WHERE poi_name IS NOT NULL GROUP BY 1) SELECT d.row_id, s.wikimedia_url AS wikimedia_url, s.poi_name FROM datasplit d JOIN s ON s.wikimedia_url = d.wikimedia_url")
def inner_join_renamed(spark, sf_dir):
    """Keys of different names, the right side's version of a shared column kept."""
    s = table(spark, sf_dir, "wikidata").where("poi_name is not null").groupBy(F.col("wikimedia_url").alias("page")).agg(F.max("poi_name").alias("poi_name"))
    d = table(spark, sf_dir, "datasplit").select("row_id", F.col("wikimedia_url").alias("listed"))
    return d.join(s, d.listed == s.page).select("row_id", F.col("page").alias("wikimedia_url"), "poi_name")


@query("WITH i AS (SELECT * FROM datasplit WHERE src = 'index'), t AS (SELECT * FROM datasplit WHERE src = 'train'), a AS (SELECT id, min(row_id) AS row_id, 'index' AS src FROM i GROUP BY id), b AS (SELECT id, min(row_id) AS row_id, 'train' AS src FROM t WHERE id NOT IN (SELECT id FROM a WHERE id IS NOT NULL) GROUP BY id) SELECT * FROM a UNION ALL SELECT * FROM b")
def left_join_recover_union(spark, sf_dir):
    """One source first, then what only the other source has: union without double ids."""
    d = table(spark, sf_dir, "datasplit").select("id", "row_id", "src").where("id is not null")
    one = relational.keep_first(d.where("src = 'index'"), ["id"], ["row_id"])
    two = relational.keep_first(d.where("src = 'train'"), ["id"], ["row_id"])
    return relational.only_missing(one, two, "id").select("id", "row_id", "src")


@query("SELECT doc_id FROM documents WHERE landmark_id IN (SELECT landmark_id FROM datasplit WHERE landmark_id IS NOT NULL)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "datasplit").select("landmark_id").distinct(), "landmark_id", "left_semi").select("doc_id")


@query("SELECT scrape_id, wikimedia_url FROM wikidata w WHERE wikimedia_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wikidata d WHERE d.wikimedia_url = w.wikimedia_url AND (d.error IS NULL OR d.error = ''))")
def anti_join_resume(spark, sf_dir):
    """What a resumed run still has to fetch."""
    w = table(spark, sf_dir, "wikidata").select("scrape_id", "wikimedia_url", "error")
    return relational.pending(w, w.where(relational.succeeded("error")), "wikimedia_url").select("scrape_id", "wikimedia_url")


@query(f"WITH c AS ({_CODES}), t AS (SELECT country_code, min(region) AS region, min(subregion) AS subregion FROM country_table GROUP BY 1) SELECT i.row_id, coalesce(i.region, t.region) AS region, coalesce(i.subregion, t.subregion) AS subregion FROM idk2 i LEFT JOIN c ON c.country = i.country LEFT JOIN t USING (country_code)")
def coalesce_fill_join(spark, sf_dir):
    i = table(spark, sf_dir, "idk2").select("row_id", "country", "region", "subregion")
    t = table(spark, sf_dir, "country_table").where("country is not null").groupBy("country").agg(F.min_by("region", "country_code").alias("region"), F.min_by("subregion", "country_code").alias("subregion"))
    return relational.fill_from(i, F.broadcast(t), ["country"], ["region", "subregion"]).select("row_id", "region", "subregion")


@query("WITH c AS (SELECT latitude, longitude, min(country_code) AS country_code FROM reverse_geocode WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2) SELECT r.geo_id, c.country_code FROM reverse_geocode r LEFT JOIN c ON c.latitude = r.latitude AND c.longitude = r.longitude")
def float_key_join(spark, sf_dir):
    """Exact equality on two coordinates, as cached lookups by coordinate need it."""
    r = table(spark, sf_dir, "reverse_geocode").select("geo_id", "latitude", "longitude", "country_code")
    c = r.where("latitude is not null and longitude is not null").groupBy("latitude", "longitude").agg(F.min("country_code").alias("code"), F.count("*").alias("n"))
    return join_counted(r.drop("country_code"), cut_lineage(c), ["latitude", "longitude"]).select("geo_id", F.col("code").alias("country_code"))


@query("WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id FROM documents) SELECT row_idx, doc_id FROM n")
def row_numbering(spark, sf_dir):
    """Dense row ids in a total order, numbered by range partition and offset."""
    return relational.row_numbers(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("row_idx", "doc_id")


@query("WITH g AS (SELECT unnest([7, 3, 3, 11, 0]) AS row_idx, generate_subscripts([7, 3, 3, 11, 0], 1) - 1 AS pos) SELECT CAST(g.pos AS INTEGER) AS pos, p.row_idx, p.id FROM g JOIN image_pool p USING (row_idx)")
def positional_gather(spark, sf_dir):
    """Rows by position: a join on the stored row id with the place in the list kept."""
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate([7, 3, 3, 11, 0])], "pos int, row_idx bigint")
    return table(spark, sf_dir, "image_pool").join(F.broadcast(wanted), "row_idx").select("pos", "row_idx", "id")


# ---- lists ---------------------------------------------------------------------------------------------------------

_SIMPLE = "p AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)"


@query(f"WITH {_SIMPLE} SELECT value, count(*) AS n FROM (SELECT unnest(words) AS value FROM p) GROUP BY value")
def explode_count(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return relational.element_counts(p, "words")


@query()
def list_filter_replace_unique(spark, sf_dir):
    """Packed fields split as in operators.packed, values replaced through a lookup, unknown ones dropped, repeats removed; empty
    results go. SQL can't split the fields; tested against plain Python."""
    m = table(spark, sf_dir, "tag_cluster").groupBy("tags").agg(F.max("human_tag_parent").alias("parent"))
    w = explode_packed(table(spark, sf_dir, "wikidata"), "scrape_id", ["instance_tag"], canonical_tags(spark, sf_dir)).select("scrape_id", F.col("value").alias("tag"))
    j = w.join(F.broadcast(m), w.tag == m.tags).where("parent is not null")
    lists = j.groupBy("scrape_id").agg(F.sort_array(F.collect_set("parent")).alias("categories"))
    return writers.flat_lists(lists.where(F.size("categories") > 0))


@query("SELECT cluster, array_to_string(list(tags ORDER BY probability DESC NULLS LAST, tags)[1:3], ',') AS tags FROM tag_cluster GROUP BY cluster")
def first_n_list(spark, sf_dir):
    return writers.flat_lists(relational.first_n(table(spark, sf_dir, "tag_cluster"), "cluster", "tags", "probability", 3))


@query("WITH d AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL) SELECT source, coalesce(array_to_string(list_sort(list(lang)), chr(10)), '') AS langs FROM d GROUP BY source")
def joined_text_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null").select("source", "lang").distinct()
    return d.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("lang")), "\n").alias("langs"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def multi_key_sort_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")).limit(50)


# ---- scalar functions over whole columns ---------------------------------------------------------------------------

_LEAD_SQL = "^(caption\\s*[:\\-]\\s*|here(?:''s| is)[^:]*:\\s*|(?:this|the)\\s+image\\s+(?:shows|depicts|features|is|presents)\\s+)"
_TIDY = f"trim(regexp_replace(trim(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), '\"''“”`'), '{_LEAD_SQL}', '', 'i'), ' ')"


@query(f"WITH t AS (SELECT doc_id, {_TIDY} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, upper(substr(t, 1, 1)) || substr(t, 2) AS caption FROM t")
def tidy_caption(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.tidy_caption(F.col("text")).alias("caption"))


@query(f"WITH t AS (SELECT doc_id, {_TIDY} AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, upper(substr(t, 1, 1)) || substr(t, 2) AS c FROM t), w AS (SELECT doc_id, c, list_filter(string_split(c, ' '), lambda x: x <> '') AS w FROM u), f AS (SELECT doc_id, c, len(w) AS n, rtrim(array_to_string(w[1:20], ' '), ' ,;:-') AS cut FROM w) SELECT doc_id, CASE WHEN n > 20 THEN CASE WHEN cut = '' OR regexp_matches(cut, '[.!?]$') THEN cut ELSE cut || '.' END ELSE c END AS caption, CAST(least(n, 20) AS INTEGER) AS n_words, CASE WHEN n > 20 THEN 'yes' ELSE 'no' END AS truncated FROM f")
def finalize_caption(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.finalize_caption(F.col("text"), 20).alias("c")).select("doc_id", "c.*")


_SHOWN = ", ".join(f"""('{a.replace("'", "''")}', '{b.replace("'", "''")}')""" for a, b in text.COUNTRY_DISPLAY.items())


@query(f"WITH m(name, shown) AS (VALUES {_SHOWN}), n AS (SELECT country AS name FROM country_table UNION ALL SELECT name FROM m) SELECT n.name, coalesce(m.shown, n.name) AS shown FROM n LEFT JOIN m USING (name)")
def country_display_map(spark, sf_dir):
    """Display names of the canonical countries and of the inverted names that the map knows; a name without an entry is its own."""
    known = spark.createDataFrame([(n,) for n in text.COUNTRY_DISPLAY], "name string")
    names = table(spark, sf_dir, "country_table").select(F.col("country").alias("name")).unionByName(known)
    return names.select("name", text.display_country(F.col("name")).alias("shown"))


@query("WITH c AS (SELECT country_code, min(country) AS country FROM country_table GROUP BY 1), a AS (SELECT alias, min(c.country) AS country FROM country_alias JOIN c USING (country_code) GROUP BY 1) SELECT i.row_id, coalesce(a.country, i.country) AS country FROM idk2 i LEFT JOIN a ON a.alias = i.country")
def country_alias_replace(spark, sf_dir):
    """Aliases replaced by the canonical name, other values kept."""
    c = table(spark, sf_dir, "country_table").groupBy("country_code").agg(F.min("country").alias("canonical"))
    a = table(spark, sf_dir, "country_alias").where("alias is not null").join(c, "country_code").groupBy(F.col("alias").alias("country")).agg(F.min("canonical").alias("canonical"))
    i = table(spark, sf_dir, "idk2").select("row_id", "country").join(bounded_table(a, 100_000, "the aliases"), "country", "left")
    return i.select("row_id", F.coalesce("canonical", "country").alias("country"))


@query("SELECT scrape_id, CASE WHEN coalesce(error, '') <> '' THEN '[error] ' || error ELSE poi_name END AS caption, coalesce(error, '') <> '' AS failed FROM wikidata")
def error_marking(spark, sf_dir):
    """A failure kept in the place of the result, and told from one."""
    w = table(spark, sf_dir, "wikidata").select("scrape_id", F.when(F.coalesce("error", F.lit("")) != "", text.mark_error(F.col("error"))).otherwise(F.col("poi_name")).alias("caption"))
    return w.select("scrape_id", "caption", text.is_error(F.col("caption")).alias("failed"))


@query("SELECT scrape_id, coalesce(regexp_matches(lower(wikimedia_url), '^[a-z]+://commons\\.heritage-archive\\.example(:[0-9]+)?/') AND regexp_matches(wikimedia_url, '^[A-Za-z]+://[^/]+/wiki/Category:'), false) AS is_category, coalesce(contains(lower(regexp_extract(geohack_url, '^[A-Za-z]+://([^/:?#]+)', 1)), 'geohack.') AND contains(geohack_url, 'params='), false) AS is_geo FROM wikidata")
def link_tests(spark, sf_dir):
    """Which links lead to a category page of the site, and which to a map with coordinates."""
    return table(spark, sf_dir, "wikidata").select("scrape_id", urls.is_category_link(F.col("wikimedia_url"), _SITE).alias("is_category"), urls.is_geo_link(F.col("geohack_url"), ("geohack.",)).alias("is_geo"))


_U = "SELECT scrape_id, geohack_url AS u FROM wikidata"


@query(f"WITH w AS ({_U}) SELECT scrape_id, lower(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(u, '[?&]params=([^&#]*)', 1) AS params, regexp_replace(u, '^http://', 'https://') AS secure FROM w WHERE u IS NOT NULL")
def url_parts(spark, sf_dir):
    w = table(spark, sf_dir, "wikidata").where("geohack_url is not null")
    u = F.col("geohack_url")
    return w.select("scrape_id", urls.host(u).alias("host"), urls.query_value(u, "params").alias("params"), urls.https(u).alias("secure"))


@query("""WITH p AS (SELECT scrape_id, regexp_extract(geohack_url, '[?&]params=([0-9.]+)_([0-9.]+)_([0-9.]+)_([NS])_([0-9.]+)_([0-9.]+)_([0-9.]+)_([EW])', ['a', 'b', 'c', 'n', 'd', 'e', 'f', 'w']) AS m FROM wikidata WHERE geohack_url IS NOT NULL)
    SELECT scrape_id, round((try_cast(m.a AS DOUBLE) + try_cast(m.b AS DOUBLE) / 60 + try_cast(m.c AS DOUBLE) / 3600) * CASE WHEN m.n = 'S' THEN -1 ELSE 1 END, 9) AS latitude, round((try_cast(m.d AS DOUBLE) + try_cast(m.e AS DOUBLE) / 60 + try_cast(m.f AS DOUBLE) / 3600) * CASE WHEN m.w = 'W' THEN -1 ELSE 1 END, 9) AS longitude FROM p""")
def coordinate_parse(spark, sf_dir):
    w = table(spark, sf_dir, "wikidata").where("geohack_url is not null").select("scrape_id", urls.coordinates(urls.query_value(F.col("geohack_url"), "params")).alias("c"))
    return w.select("scrape_id", F.round("c.latitude", 9).alias("latitude"), F.round("c.longitude", 9).alias("longitude"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""WITH t AS (SELECT scrape_id, unnest(json_keys(poi_name_tags)) AS lang, poi_name_tags AS j FROM wikidata WHERE poi_name_tags IS NOT NULL), a AS (SELECT scrape_id, lang, CAST(json_extract(j, '$."' || lang || '"') AS VARCHAR[]) AS names, 1 AS k FROM t),
    p AS (SELECT scrape_id, 'en' AS lang, [poi_name] AS names, 0 AS k FROM wikidata WHERE poi_name IS NOT NULL), u AS (SELECT scrape_id, lang, flatten(list(names ORDER BY k)) AS names FROM (SELECT * FROM a UNION ALL SELECT * FROM p) GROUP BY 1, 2)
    SELECT scrape_id, lang, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|') AS names FROM u""")
def json_map_merge(spark, sf_dir):
    """Names by language: the page's heading first, then the names of the tags, each once."""
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,array<string>>")
    w = table(spark, sf_dir, "wikidata")
    names = F.coalesce(F.from_json("poi_name_tags", "map<string,array<string>>"), empty)
    label = F.when(F.col("poi_name").isNotNull(), F.create_map(F.lit("en"), F.array("poi_name"))).otherwise(empty)
    merged = F.map_zip_with(label, names, lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))))
    return w.select("scrape_id", F.explode(merged).alias("lang", "names")).select("scrape_id", "lang", F.array_join("names", "|").alias("names"))


@query("""WITH w AS (SELECT scrape_id, poi_name, osm_id, scrape_id % 4 AS k FROM wikidata WHERE wikidata_id IS NOT NULL)
    SELECT scrape_id, poi_name AS name_en, CASE WHEN poi_name IS NOT NULL THEN 'alias of ' || poi_name END AS alias_xa, CASE k WHEN 0 THEN 'relation/' WHEN 1 THEN 'node/' WHEN 2 THEN 'way/' END || osm_id AS place FROM w""")
def entity_documents(spark, sf_dir):
    """A knowledge base's JSON documents, one a scrape: names by language with their aliases, and the place that the most trusted
    claim names. The documents are made here from the columns, with claims of less trust beside the one that counts."""
    q = lambda c: F.to_json(F.struct(F.col(c).alias("value")))
    claim = lambda p, value: F.concat(F.lit(f'"{p}":[{{"mainsnak":{{"datavalue":'), value, F.lit('}},{"mainsnak":{"datavalue":{"value":"later"}}}]'))
    w = table(spark, sf_dir, "wikidata").where("wikidata_id is not null").withColumn("k", F.col("scrape_id") % 4).withColumn("alias", F.concat(F.lit("alias of "), "poi_name"))
    less = F.lit('{"value":"less"}')
    given = F.when(F.col("osm_id").isNull() | (F.col("k") == 3), F.lit("")).otherwise(
        F.when(F.col("k") == 0, F.concat(claim("P10689", less), F.lit(","), claim("P402", q("osm_id")), F.lit(","), claim("P11693", less))).when(F.col("k") == 1, F.concat(claim("P10689", less), F.lit(","), claim("P11693", q("osm_id")))).otherwise(claim("P10689", q("osm_id")))
    )
    names = F.when(F.col("poi_name").isNull(), F.lit('"labels":{},"aliases":{}')).otherwise(F.concat(F.lit('"labels":{"en":'), q("poi_name"), F.lit('},"aliases":{"xa":['), q("alias"), F.lit("]}")))
    document = F.concat(F.lit('{"entities":{"'), "wikidata_id", F.lit('":{'), names, F.lit(',"claims":{'), given, F.lit("}}}}"))
    e = w.select("scrape_id", text.parse_entity(document, F.col("wikidata_id")).alias("e")).select("scrape_id", text.entity_names(F.col("e")).alias("names"), text.entity_place(F.col("e")).alias("place"))
    first = lambda lang: F.get(F.try_element_at("names", F.lit(lang)), F.lit(0))
    return e.select("scrape_id", first("en").alias("name_en"), first("xa").alias("alias_xa"), "place")


@query("SELECT scrape_id, coalesce(nullif(osm_id, ''), nullif(wikidata_id, ''), nullif(poi_name, '')) AS claim FROM wikidata")
def claim_priority(spark, sf_dir):
    """The first filled of several claims in order of trust."""
    return table(spark, sf_dir, "wikidata").select("scrape_id", text.first_filled(F.col("osm_id"), F.col("wikidata_id"), F.col("poi_name")).alias("claim"))


@query("SELECT row_id, concat_ws('/', src, CASE WHEN id LIKE '%.jpg' THEN id ELSE id || '.jpg' END) AS path, replace(id, '/', '_') AS flat_id, 'A street view photo taken in ' || concat_ws(', ', split, country) AS place, concat_ws(chr(10), 'Describe.', CASE WHEN coalesce(pred_label, '') <> '' THEN 'Category: ' || pred_label END, CASE WHEN coalesce(country, '') <> '' THEN 'Country: ' || country END) AS prompt FROM datasplit WHERE id IS NOT NULL")
def text_columns(spark, sf_dir):
    """Paths, flat ids, place texts and prompts of every listing."""
    d = table(spark, sf_dir, "datasplit").where("id is not null")
    return d.select("row_id", text.image_path(F.col("src"), F.col("id")).alias("path"), F.replace("id", F.lit("/"), F.lit("_")).alias("flat_id"), text.place_text(F.col("split"), F.lit(None).cast("string"), F.col("country")).alias("place"), text.prompt(F.lit("Describe."), F.col("pred_label"), F.col("country")).alias("prompt"))


@query("SELECT geo_id, nullif(upper(country_code), '') AS code, coalesce(nullif(city, ''), nullif(subregion, ''), nullif(region, '')) AS place FROM reverse_geocode")
def place_columns(spark, sf_dir):
    r = table(spark, sf_dir, "reverse_geocode")
    return r.select("geo_id", text.country_code(F.col("country_code")).alias("code"), text.first_filled(F.col("city"), F.col("subregion"), F.col("region")).alias("place"))


_GOOD = "g AS (SELECT geo_id, latitude AS lat, longitude AS lon FROM reverse_geocode WHERE abs(latitude) < 85 AND abs(longitude) <= 180)"


def _good(spark, sf_dir) -> DataFrame:
    """All coordinates in range; no row of the tables lies in the SQL twins' gap of 85 degrees and beyond."""
    return table(spark, sf_dir, "reverse_geocode").where("abs(latitude) <= 90 and abs(longitude) <= 180").select("geo_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


@query(f"WITH {_GOOD}, t AS (SELECT *, asin(sqrt(3.0) / 2 * sin(radians(lat))) AS t FROM g) SELECT geo_id, round(2 * sqrt(3.0) * radians(lon) * cos(t) / (3 * (9 * 0.003796 * t ** 8 + 7 * 0.000893 * t ** 6 + 3 * -0.081106 * t ** 2 + 1.340264)) * 66.50336 / 180, 8) AS x, round((0.003796 * t ** 9 + 0.000893 * t ** 7 + -0.081106 * t ** 3 + 1.340264 * t) * 66.50336 / 180, 8) AS y FROM t")
def equal_earth(spark, sf_dir):
    return _rounded(_good(spark, sf_dir).select("geo_id", geo.equal_earth(F.col("lat"), F.col("lon")).alias("p")).select("geo_id", "p.x", "p.y"), "x", "y", digits=8)


@query(f"WITH {_GOOD} SELECT geo_id, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 / 20037508.3427892, 8) AS y, round(radians(lon) * 6378137 / 20037508.3427892, 8) AS x FROM g")
def web_mercator(spark, sf_dir):
    return _rounded(_good(spark, sf_dir).select("geo_id", geo.web_mercator(F.col("lat"), F.col("lon")).alias("p")).select("geo_id", "p.y", "p.x"), "x", "y", digits=8)


@query(f"WITH {_GOOD} SELECT geo_id, round(cos(2 * pi() * lat / 90), 8) AS basic_1, round(sin(2 * pi() * lon / 180), 8) AS basic_4, round(cos(2 * pi() * 10 ** 0.5 * lat / 90), 8) AS positional_2, round(sin(2 * pi() * lon / 180), 8) AS positional_7, round(cos(2 * pi() * (0.5 * lat / 90 - 0.25 * lon / 180)), 8) AS gaussian_1 FROM g")
def fourier_features(spark, sf_dir):
    v = F.array(F.col("lat") / 90, F.col("lon") / 180)
    g = _good(spark, sf_dir).select("geo_id", geo.basic_encoding(v).alias("b"), geo.positional_encoding(v, 10.0, 2).alias("p"), geo.gaussian_encoding(v, [[0.5, -0.25], [1.0, 2.0]]).alias("s"))
    at = lambda c, i: F.round(F.element_at(c, i), 8)
    return g.select("geo_id", at("b", 1).alias("basic_1"), at("b", 4).alias("basic_4"), at("p", 2).alias("positional_2"), at("p", 7).alias("positional_7"), at("s", 1).alias("gaussian_1"))


@query("WITH r AS (SELECT geo_id, latitude AS lat, longitude AS lon FROM reverse_geocode WHERE abs(latitude) <= 90 AND abs(longitude) <= 180), d AS (SELECT geo_id, zone_id, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(centre_latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(centre_latitude)) * pow(sin(radians(centre_longitude - lon) / 2), 2)))), 3) AS m FROM r, city_zone), b AS (SELECT geo_id, zone_id, m FROM d QUALIFY row_number() OVER (PARTITION BY geo_id ORDER BY m, zone_id) = 1) SELECT geo_id, CAST(zone_id AS BIGINT) AS place_id, round(m / 1000, 0) AS km FROM reverse_geocode LEFT JOIN b USING (geo_id)")
def nearest_place(spark, sf_dir):
    found = places.nearest_place(table(spark, sf_dir, "reverse_geocode"), "geo_id", "latitude", "longitude", table(spark, sf_dir, "city_zone"), "zone_id", "centre_latitude", "centre_longitude")
    return found.select("geo_id", "place_id", F.round(F.col("metres") / 1000, 0).alias("km"))


@query("WITH d AS (SELECT l_orderkey, list(l_linenumber) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_filter(a, lambda x: x IN (1, 3, 5))) / len(a) AS ratio, len(list_filter(a, lambda x: x IN (1, 3, 5))) / len(a) >= 0.5 AS is_landmark FROM d")
def segment_ratio(spark, sf_dir):
    """The share of wanted classes in an array of class ids, and whether it reaches the threshold."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"))
    ratio = F.size(F.filter("a", lambda x: x.isin(1, 3, 5))) / F.size("a")
    return d.select("l_orderkey", ratio.alias("ratio"), (ratio >= 0.5).alias("is_landmark"))


# ---- pages, providers, streams -------------------------------------------------------------------------------------

_SITE, _GEO = "commons.heritage-archive.example", ("geohack.heritage-archive.example",)


def _pages(spark, sf_dir, moves: bool = False) -> DataFrame:
    """A category page for every scrape, without the elements of its null fields; with moves, every fifth has a notice, every third
    says where it is now, and all have a plain link."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    part = lambda before, c, after: F.coalesce(F.concat(F.lit(before), safe(c), F.lit(after)), F.lit(""))
    link = lambda name: F.concat(F.lit(f'<a href="/wiki/Category:{name}_'), F.col("scrape_id").cast("string"), F.lit('">link</a>'))
    some = lambda n, *html: F.when(F.lit(moves) & (F.col("scrape_id") % n == 0), F.concat(*html)).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<html><head><script>var x = "</p>";</script>'), part('<link rel="canonical" href="', "wikimedia_url", '">'), F.lit("</head><body>"),
        part('<h1 id="firstHeading">Category:', "poi_name", "</h1>"), some(5, F.lit('<div class="hatnote">Not '), link("Hat"), F.lit("</div>")), F.lit('<div id="mw-content-text">'), some(1, F.lit("<ul><li>"), link("Plain"), F.lit("</li></ul>")),
        some(3, F.lit("<p>This page is now at "), link("New"), F.lit("</p>")), F.lit("<p>About"), part('<a href="', "geohack_url", '">map</a><br>'), part('<a href="https://www.wikidata.org/wiki/', "wikidata_id", '">item</a>'), F.lit("</p></div>"),
        part('<table id="wdinfobox"><tr><th class="wikidatainfobox-lcell">Instance of</th><td><a>', "instance_tag", '</a></td></tr><tr><th class="wikidatainfobox-lcell">Height</th><td><a>12</a></td></tr></table>'), F.lit("</body></html>"),
    )
    return table(spark, sf_dir, "wikidata").select("scrape_id", html.alias("html"), "wikimedia_url")


_PLAIN_TEXT = "trim(regexp_replace({}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g'), ' ')"


@query(f"""WITH w AS (SELECT *, lower(regexp_extract(wikimedia_url, '^[A-Za-z]+://([^/:?#]+)', 1)) = '{_SITE}' AS here, regexp_extract(wikimedia_url, '^[A-Za-z]+://[^/]+') || '/wiki/Category:' AS base FROM wikidata),
    l AS (SELECT *, [CASE WHEN here AND scrape_id % 5 = 0 THEN base || 'Hat_' || scrape_id END, CASE WHEN here AND scrape_id % 3 = 0 THEN base || 'New_' || scrape_id END, CASE WHEN here AND regexp_matches(wikimedia_url, '^[A-Za-z]+://[^/]+/wiki/Category:') THEN wikimedia_url END, CASE WHEN here THEN base || 'Plain_' || scrape_id END] AS links FROM w)
    SELECT scrape_id, geohack_url, {_PLAIN_TEXT.format('poi_name')} AS poi_name, nullif(regexp_extract('/' || wikidata_id, '/(Q[0-9]+)(?:[^0-9]|$)', 1), '') AS wikidata_id, nullif({_PLAIN_TEXT.format('instance_tag')}, '') AS instance_tag, array_to_string(list_filter(links, lambda x: x IS NOT NULL), ' ') AS candidate_links FROM l""")
def page_links(spark, sf_dir):
    """All parsed fields of pages with notices, moves and plain links, the links best first."""
    return pages.page_fields(_pages(spark, sf_dir, moves=True), "scrape_id", "html", "wikimedia_url", _SITE, _GEO).withColumn("candidate_links", F.array_join("candidate_links", " "))


@query()
def page_fields(spark, sf_dir):
    """All parsed fields of every page, its links as a list; tested against plain Python."""
    return pages.page_fields(_pages(spark, sf_dir), "scrape_id", "html", "wikimedia_url", _SITE, _GEO)


def _site(url: str) -> tuple[str, str]:
    """A made-up site: every page has moved once; the new one has the fields, or leads on to one that has the place, or is gone."""
    name = url.rsplit(":", 1)[-1]
    kind = len(url.removeprefix("https://")) % 3
    if name.startswith("Moved_"):
        kind = (len(url.removeprefix("https://")) - len("Moved_")) % 3
    meta = f'<h1 id="firstHeading">Category:{name}</h1><a href="https://www.wikidata.org/wiki/Q7">q</a>'
    place = f'<a href="https://{_GEO[0]}/x?params=1_{len(url) % 60}_N_2_15_W">m</a>'
    if not name.startswith(("Moved_", "Found_")):
        return url, f'<div id="mw-content-text"><p>This category is now at <a href="/wiki/Category:Moved_{name}">here</a></p></div>'
    if name.startswith("Found_"):
        return url, place
    if kind == 2:
        raise ValueError("gone")
    return url, meta + (place if kind == 0 else f'<div class="hatnote">See <a href="/wiki/Category:Found_{name}">map</a></div>')


@query("""WITH u AS (SELECT DISTINCT wikimedia_url AS u FROM wikidata WHERE wikimedia_url IS NOT NULL), s AS (SELECT u, regexp_replace(u, '^http://', 'https://') AS a, regexp_extract(u, '([^:]*)$', 1) AS name FROM u),
    k AS (SELECT *, length(a) - 8 AS n, 'https://commons.heritage-archive.example/wiki/Category:Moved_' || name AS moved FROM s),
    t AS (SELECT *, (length(moved) - 8 - 6) % 3 AS kind FROM k)
    SELECT u AS input_url, CASE kind WHEN 0 THEN round(1 + (length(moved) % 60) / 60.0, 9) WHEN 1 THEN round(1 + ((length(moved) + 6) % 60) / 60.0, 9) END AS latitude, CASE WHEN kind < 2 THEN -2.25 END AS longitude, CASE WHEN kind < 2 THEN 'Moved_' || name END AS poi_name, CASE kind WHEN 1 THEN 3 ELSE 2 END AS pages, CASE WHEN kind = 2 THEN 'ValueError: gone' END AS error FROM t""")
def bfs_crawl(spark, sf_dir):
    w = table(spark, sf_dir, "wikidata")
    found = pages.crawl(w, "wikimedia_url", _site, _SITE, _GEO, tries=1)
    return found.select("input_url", F.round("latitude", 9).alias("latitude"), "longitude", "poi_name", "pages", "error")


def _provider(row: dict) -> str:
    """Fails on the first run for every third document, so that a second run has something to do."""
    if row["doc_id"] % 3 == 0 and row["run"] == 1:
        raise enrich.Retry("busy")
    return f"caption {row['doc_id']}"


@query("SELECT doc_id, 'caption ' || doc_id AS result, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS run FROM documents")
def provider_enrich_resume(spark, sf_dir):
    """Two runs over the same input: the second calls only for what failed."""
    d, path = table(spark, sf_dir, "documents").select("doc_id"), scratch(spark, "enrich")
    for run in (1, 2):
        state = enrich.resume(spark, d.withColumn("run", F.lit(run)), "doc_id", ["run"], _provider, path, run)
    return state.select("doc_id", "result", "run")


@query(SQL["last_success_wins"])
def stream_last_success(spark, sf_dir):
    """The batch rule over a file stream."""
    whole = table(spark, sf_dir, "wikidata").select("wikimedia_url", "scrape_id", "error", "scraped_at")
    source, state, checkpoint = scratch(spark, "in"), scratch(spark, "state"), scratch(spark, "stream")
    whole.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    enrich.stream_last_success(stream, "wikimedia_url", "error", ["scraped_at", "scrape_id"], state, checkpoint).awaitTermination()
    return spark.read.parquet(state).select("wikimedia_url", "scrape_id", "error")


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return readers.csv_typed(spark, path, "doc_id bigint, text string, lang string, n_chars bigint")


@query("SELECT country_code, country, region, subregion FROM country_table")
def csv_strings(spark, sf_dir):
    path = scratch(spark, "strings")
    writers.write_csv(table(spark, sf_dir, "country_table"), path)
    return readers.csv_strings(spark, path).select("country_code", "country", "region", "subregion")


@query("SELECT country_code, country FROM country_table WHERE country IS NOT NULL AND country_code IS NOT NULL")
def wrapped_json(spark, sf_dir):
    path = scratch(spark, "json")
    writers.write_wrapped_json(table(spark, sf_dir, "country_table").where("country is not null and country_code is not null").select("country_code", "country"), path)
    return readers.wrapped_json(spark, path, "country_code string, country string")


@query("SELECT row_number() OVER (ORDER BY zone_id) - 1 AS row_idx, city FROM city_zone")
def indexed_metadata(spark, sf_dir):
    path = scratch(spark, "meta")
    writers.write_wrapped_json(table(spark, sf_dir, "city_zone").select("zone_id", "city").orderBy("zone_id").coalesce(1), path, "metadata")
    return readers.indexed_metadata(spark, path, "zone_id int, city string").select("row_idx", "city")


@query("SELECT split, count(*) AS n FROM datasplit GROUP BY split")
def partitioned_sink(spark, sf_dir):
    path = scratch(spark, "split")
    writers.write_by(table(spark, sf_dir, "datasplit").select("row_id", "split"), path, "split")
    return relational.counts(spark.read.schema("row_id bigint, split string").parquet(path), "split")


@query("SELECT src, count(*) AS n FROM datasplit WHERE id IS NOT NULL AND src IS NOT NULL GROUP BY src")
def text_file_lists(spark, sf_dir):
    path = scratch(spark, "lists")
    d = table(spark, sf_dir, "datasplit").where("id is not null and src is not null")
    writers.write_by(d.select(F.replace("id", F.lit("\n"), F.lit(" ")).alias("value"), "src"), path, "src", form="text")
    return relational.counts(spark.read.schema("value string, src string").text(path), "src")


@query("SELECT row_idx, id FROM image_pool WHERE row_idx % 2 = 0")
def swap_overwrite(spark, sf_dir):
    """A table replaced by a selection of itself."""
    path = scratch(spark, "swap")
    table(spark, sf_dir, "image_pool").select("row_idx", "id").write.parquet(path)
    writers.swap(spark, path, spark.read.parquet(path).where("row_idx % 2 = 0"))
    return spark.read.parquet(path)


@query("SELECT vec_id AS row_idx, len(embedding) AS width, label FROM embeddings")
def vector_table(spark, sf_dir):
    path = scratch(spark, "vectors")
    writers.write_vectors(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_idx"), path)
    return readers.vectors(spark, path).select("row_idx", F.size("embedding").cast("bigint").alias("width"), "label")


@query("SELECT row_id, lower(trim(pred_label, ' ')) AS category FROM idk2 WHERE pred_label IS NOT NULL")
def harmonised_names(spark, sf_dir):
    d = readers.harmonise(table(spark, sf_dir, "idk2")).where("category is not null")
    return d.select("row_id", _label("category").alias("category"))


@query("SELECT country_code, coalesce(CASE WHEN country LIKE 'Saint%' THEN NULL ELSE country END, 'gazetteer ' || country_code) AS country, coalesce(region, 'none') AS region, subregion FROM country_table")
def country_table_build(spark, sf_dir):
    """Official names and continents over gazetteer ones, 'not found' as no subregion."""
    c = table(spark, sf_dir, "country_table")
    codes = c.select("country_code", F.concat(F.lit("gazetteer "), "country_code").alias("gazetteer_name"), F.lit("none").alias("gazetteer_continent"))
    official = c.where("country not like 'Saint%'").select("country_code", F.col("country").alias("official_name"))
    return readers.country_table(codes, official, c.select("country_code", F.col("region").alias("continent")), c.select("country_code", F.coalesce("subregion", F.lit("not found")).alias("subregion_name")))


@query(SQL["map_by_label"])
def metric_report(spark, sf_dir):
    """Slices as nested JSON, one object per kind of slice, written and read back."""
    path = scratch(spark, "report")
    m = map_by_label(spark, sf_dir).select(F.lit("by_label").alias("slice_type"), F.col("label").cast("string").alias("slice_key"), "metric", "k", "value")
    writers.metric_report(m, path)
    read = spark.read.text(path).select(F.from_json("value", "slice_type string, groups map<string,string>").alias("r")).select(F.explode("r.groups").alias("label", "scores"))
    long = read.select(F.col("label").cast("int").alias("label"), F.explode(F.from_json("scores", "map<string,double>")).alias("name", "value"))
    return long.select("label", F.split_part("name", F.lit("@"), F.lit(1)).alias("metric"), F.split_part("name", F.lit("@"), F.lit(2)).cast("int").alias("k"), "value")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0")
def tolerant_csv(spark, sf_dir):
    """Lines that end early are kept as far as they go, lines without a key go."""
    path = scratch(spark, "damaged")
    d = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("doc_id").cast("string"))).otherwise(F.concat(F.when(F.col("doc_id") % 11 == 0, F.lit(" ")).otherwise(F.col("doc_id").cast("string")), F.lit(","), F.coalesce("lang", F.lit("")), F.lit(",more")))
    d.select(line.alias("value")).write.text(path)
    rows = readers.csv_tolerant(spark, path, "doc_id string, lang string, source string", "doc_id", ["doc_id", "lang"], header=False)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang")


@query("SELECT CAST(cluster AS VARCHAR) AS label, tags AS prompt, row_number() OVER (PARTITION BY cluster ORDER BY tags) - 1 AS pos FROM tag_cluster WHERE cluster IS NOT NULL AND tags IS NOT NULL")
def label_prompts(spark, sf_dir):
    """A JSON map of labels to prompts, written whole and read as rows."""
    path = scratch(spark, "prompts")
    per = table(spark, sf_dir, "tag_cluster").where("cluster is not null and tags is not null").groupBy(F.col("cluster").cast("string").alias("label")).agg(F.sort_array(F.collect_list("tags")).alias("prompts"))
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "prompts")))).alias("value")).coalesce(1).write.text(path)
    return readers.label_prompts(spark, path).select("label", "prompt", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT latitude AS LAT, longitude AS LON FROM reverse_geocode WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")
def gallery_scan(spark, sf_dir):
    """A gallery of coordinates through a CSV file."""
    path = scratch(spark, "gallery")
    r = table(spark, sf_dir, "reverse_geocode").where("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")
    writers.write_csv(r.select(F.col("latitude").alias("LAT"), F.col("longitude").alias("LON")), path)
    return readers.gallery(spark, path)


# ---- providers of other kinds --------------------------------------------------------------------------------------


@query("SELECT doc_id, round(a / sqrt(a * a + b * b), 5) AS x, round(b / sqrt(a * a + b * b), 5) AS y FROM (SELECT doc_id, coalesce(length(text), 0) + 1.0 AS a, doc_id % 97 + 1.0 AS b FROM documents)")
def encoded_vectors(spark, sf_dir):
    """An encoder that turns batches of rows into vectors, and the unit vectors that an index holds."""
    encoder = lambda b: np.column_stack([b["n"] + 1, b["doc_id"] % 97 + 1])
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    v = enrich.encode(d, "doc_id", ["n"], encoder, 2).select("doc_id", vectors.l2_normalise(F.col("embedding")).alias("v"))
    return v.select("doc_id", F.round(F.get("v", F.lit(0)), 5).alias("x"), F.round(F.get("v", F.lit(1)), 5).alias("y"))


def _geocoder(place: dict) -> dict | None:
    """Knows nothing south of the equator."""
    if place["latitude"] < 0:
        raise enrich.Retry("no answer")
    return {"city": f"cell {int(place['latitude'] // 1)} {int(place['longitude'] // 1)}"}


@query("SELECT geo_id, CASE WHEN city IS NULL AND latitude >= 0 AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) THEN 'cell ' || CAST(floor(latitude) AS BIGINT) || ' ' || CAST(floor(longitude) AS BIGINT) ELSE city END AS city FROM reverse_geocode")
def geocode_fallback(spark, sf_dir):
    """Missing cities asked for once per distinct coordinate; what the service doesn't know stays null."""
    r = table(spark, sf_dir, "reverse_geocode").select("geo_id", "latitude", "longitude", "city")
    return enrich.geocode_missing(r, "latitude", "longitude", "city", _geocoder, ["city"], 0.0).select("geo_id", "city")


@query("SELECT country_code, 'note on ' || country_code AS result FROM country_table WHERE country_code IS NOT NULL")
def rate_limited_calls(spark, sf_dir):
    """One partition, at most a call each millisecond."""
    c = table(spark, sf_dir, "country_table").where("country_code is not null").select("country_code")
    return enrich.enrich(c, "country_code", [], lambda row: f"note on {row['country_code']}", concurrency=1, interval=0.001).select("country_code", "result")
