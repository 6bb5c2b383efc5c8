"""The queries of the general data problems: packed fields, nearby points, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.hotkeys import hot_keys, key_states
from waymark.operators.nearby import near_counts, near_rows, zone_of
from waymark.operators.packed import explode_packed
from waymark.runtime import bounded_rows, bounded_table, table

PACKED = ("instance_tag", "category", "cluster_id")
NEAR_M = 50.0
HOT_SHARE = 0.02


def canonical_tags(spark: SparkSession, sf_dir: str) -> list[str]:
    """The canonical tags, a fixed table, whose inner marks aren't separators."""
    return [r[0] for r in bounded_rows(table(spark, sf_dir, "tag_cluster").select("tags").where("tags is not null"), 100_000, "tag_cluster")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "wikidata"), "scrape_id", PACKED, canonical_tags(spark, sf_dir), least=2)


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values, single ones too."""
    return explode_packed(table(spark, sf_dir, "wikidata"), "scrape_id", PACKED, canonical_tags(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_rows(table(spark, sf_dir, "reverse_geocode"), "geo_id", "id", "latitude", "longitude", NEAR_M)


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row the rows at and near its place, and the zone that holds it."""
    rows = table(spark, sf_dir, "reverse_geocode")
    zones = table(spark, sf_dir, "city_zone")
    held = zone_of(rows, "geo_id", "latitude", "longitude", zones)
    near = near_counts(held, "geo_id", "latitude", "longitude", NEAR_M, keep=["zone_id"])
    names = bounded_table(zones.where("zone_id is not null").groupBy("zone_id").agg(F.min("city").alias("zone_city")), 100_000, "the zone table")
    return near.join(names, "zone_id", "left").select("geo_id", "n_here", "n_near", F.round("nearest_m", 2).alias("nearest_m"), "zone_id", "zone_city")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda name, key: hot_keys(key_states(table(spark, sf_dir, name), key, None, "row_id"), HOT_SHARE).select(F.lit(f"{name}.{key}").alias("field"), F.col("key").cast("string").alias("hot_key"))
    return found("datasplit", "landmark_id").unionByName(found("idk2", "country"))


def p4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key: rows, first and last time, longest time between neighbours, and how often the label changes on the way."""

    def states(name: str, key: str, order: str) -> DataFrame:
        s = key_states(table(spark, sf_dir, name), key, F.unix_micros(F.col(order).cast("timestamp")), "row_id", F.lower(F.trim("pred_label")))
        seconds = lambda c: F.timestamp_micros(F.col(c).cast("bigint"))
        return s.select(F.lit(f"{name}.{key}").alias("field"), F.col("key").cast("string").alias("key"), "n", seconds("first_at").alias("first_at"), seconds("last_at").alias("last_at"), (F.col("longest_gap") / 1e6).alias("longest_gap_s"), "n_runs")

    return states("datasplit", "landmark_id", "added_at").unionByName(states("idk2", "country", "merged_at"))


QUERIES = {f.__name__: f for f in (p2_found, p2_values, p3_found, p3_places, p4_found, p4_keys)}

SQL = {
    "p3_places": """
        WITH g AS (SELECT geo_id, latitude AS la, longitude AS lo FROM reverse_geocode WHERE abs(latitude) <= 90 AND abs(longitude) <= 180),
        h AS (SELECT la, lo, count(*) AS n_here FROM g GROUP BY 1, 2),
        d AS (SELECT a.la, a.lo, b.n_here AS n, 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) AS m
              FROM h a JOIN h b ON b.la BETWEEN a.la - 0.0006 AND a.la + 0.0006 AND (a.la <> b.la OR a.lo <> b.lo)),
        n AS (SELECT la, lo, CAST(sum(n) AS BIGINT) AS n_near, min(m) AS nearest_m FROM d WHERE m <= 50 GROUP BY 1, 2),
        c AS (SELECT zone_id, len(ring_latitude) AS k, unnest(range(1, len(ring_latitude) + 1)) AS i, ring_latitude AS ys, ring_longitude AS xs FROM city_zone WHERE ring_latitude IS NOT NULL AND ring_longitude IS NOT NULL),
        e AS (SELECT zone_id, xs[i] + 360 * round((xs[1] - xs[i]) / 360) AS xa, ys[i] AS ya, xs[i % k + 1] + 360 * round((xs[1] - xs[i % k + 1]) / 360) AS xb, ys[i % k + 1] AS yb FROM c),
        o AS (SELECT zone_id, least(xa, xb) AS x1, greatest(xa, xb) AS x2, CASE WHEN xa <= xb THEN ya ELSE yb END AS y1, CASE WHEN xa <= xb THEN yb ELSE ya END AS y2 FROM e WHERE xa <> xb),
        s AS (SELECT zone_id, x1 + t AS x1, x2 + t AS x2, y1, y2 FROM o, (SELECT unnest([-360, 0, 360]) AS t)),
        p AS (SELECT h.la, h.lo, zone_id FROM h JOIN s ON h.lo >= x1 AND h.lo < x2 AND y1 + (h.lo - x1) / (x2 - x1) * (y2 - y1) <= h.la GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
        z AS (SELECT la, lo, min(zone_id) AS zone_id FROM p GROUP BY 1, 2)
        SELECT r.geo_id, h.n_here, CASE WHEN h.n_here IS NOT NULL THEN coalesce(n.n_near, 0) END AS n_near, round(n.nearest_m, 2) AS nearest_m, z.zone_id, (SELECT min(city) FROM city_zone WHERE zone_id = z.zone_id) AS zone_city
        FROM reverse_geocode r LEFT JOIN g USING (geo_id) LEFT JOIN h ON h.la = g.la AND h.lo = g.lo LEFT JOIN n ON n.la = g.la AND n.lo = g.lo LEFT JOIN z ON z.la = g.la AND z.lo = g.lo""",
    "p3_found": """
        WITH g AS (SELECT geo_id, id, radians(latitude) AS la, radians(longitude) AS lo FROM reverse_geocode WHERE abs(latitude) <= 90 AND abs(longitude) <= 180)
        SELECT a.geo_id AS geo_id_1, b.geo_id AS geo_id_2 FROM g a JOIN g b ON a.geo_id < b.geo_id AND b.la BETWEEN a.la - 0.00001 AND a.la + 0.00001
        WHERE a.id IS DISTINCT FROM b.id
            AND 2 * 6371008.8 * asin(sqrt(least(1, pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2)))) <= 50""",
    "p4_found": """
        SELECT 'datasplit.landmark_id' AS field, CAST(landmark_id AS VARCHAR) AS hot_key FROM datasplit WHERE landmark_id IS NOT NULL
        GROUP BY landmark_id HAVING count(*) > 0.02 * (SELECT count(landmark_id) FROM datasplit)
        UNION ALL
        SELECT 'idk2.country', country FROM idk2 WHERE country IS NOT NULL
        GROUP BY country HAVING count(*) > 0.02 * (SELECT count(country) FROM idk2)""",
    "p4_keys": """
        WITH r AS (
            SELECT 'datasplit.landmark_id' AS field, CAST(landmark_id AS VARCHAR) AS key, added_at AS t, row_id, coalesce(lower(trim(pred_label, ' ')), '') AS label
            FROM datasplit WHERE landmark_id IS NOT NULL
            UNION ALL
            SELECT 'idk2.country', country, merged_at, row_id, coalesce(lower(trim(pred_label, ' ')), '') FROM idk2 WHERE country IS NOT NULL),
        s AS (SELECT *, lag(t) OVER w AS t_0, lag(label) OVER w AS label_0 FROM r
              WINDOW w AS (PARTITION BY field, key ORDER BY t NULLS FIRST, row_id))
        SELECT field, key, count(*) AS n, min(t) AS first_at, max(t) AS last_at,
            (max(epoch_us(t) - epoch_us(t_0)) / 1e6) AS longest_gap_s,
            CAST(count(CASE WHEN label <> label_0 THEN 1 END) + 1 AS BIGINT) AS n_runs
        FROM s GROUP BY field, key""",
}
