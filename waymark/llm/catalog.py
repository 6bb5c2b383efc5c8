"""The queries of the training-data problems, and SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import canonical, grouped_splits, mixing, packing, quality, sampling, terms
from waymark.llm.tokens import token_counts
from waymark.plans.data_problems import canonical_tags
from waymark.operators.packed import explode_packed
from waymark.runtime import bounded_rows, bounded_table, cut_lineage, join_counted, table

POOL_FIELDS = ["category", "continent", "country"]


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image_pool").select("id", *POOL_FIELDS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exhausted(_pool(spark, sf_dir), table(spark, sf_dir, "sample_target"), "id", POOL_FIELDS).select("plan_id", "field_name", "field_value")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(_pool(spark, sf_dir), table(spark, sf_dir, "sample_target"), "id", POOL_FIELDS)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.report(_pool(spark, sf_dir), table(spark, sf_dir, "sample_target"), "id", POOL_FIELDS)


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = terms.packed_term_counts(table(spark, sf_dir, "wikidata"), "instance_tag", canonical_tags(spark, sf_dir))
    labels = terms.plain_term_counts(table(spark, sf_dir, "datasplit"), "pred_label")
    return terms.term_frequencies(tags, "wikidata.instance_tag").unionByName(terms.term_frequencies(labels, "datasplit.pred_label"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "datasplit")
    return grouped_splits.linked_pairs(rows, F.col("landmark_id"), grouped_splits.image_key("id")).toDF("landmark_id_1", "landmark_id_2")


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = cut_lineage(grouped_splits.row_groups(table(spark, sf_dir, "datasplit"), "row_id", "landmark_id", grouped_splits.image_key("id"), sampling.plain("pred_label")))
    return grouped_splits.split_rows(grouped).select(F.col("key").alias("row_id"), "kind", "grp", "label", "split")


def p6_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir).select("row_id", "split")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by split and label, with the split's share of the label."""
    n = _split_rows(spark, sf_dir).groupBy("label", "split").agg(F.count("*").alias("n"))
    whole = n.groupBy("label").agg(F.sum("n").alias("label_n"))
    return n.join(whole, "label").select("label", "split", "n", (F.col("n") / F.col("label_n")).alias("share"))


def _matchers(spark: SparkSession, sf_dir: str) -> dict[str, tuple[canonical.Matcher, list[str]]]:
    """By field: the matcher and the entries that a value may equal letter for letter."""
    read = lambda name, *cols: bounded_rows(table(spark, sf_dir, name).select(*cols).where(" and ".join(f"{c} is not null" for c in cols)).orderBy(*cols), canonical.MAX_ENTRIES, name)
    tags = [r[0] for r in read("tag_cluster", "tags")]
    countries = [(r[1], r[0]) for r in read("country_table", "country_code", "country")]
    aliases = [(r[0], r[1]) for r in read("country_alias", "alias", "country_code")]
    codes = {code.lower(): code for _, code in countries}
    return {"wikidata.instance_tag": (canonical.Matcher([(t, t) for t in tags]), tags), "idk2.country": (canonical.Matcher(countries + aliases, codes), [name for name, _ in countries])}


def _typed(spark: SparkSession, sf_dir: str, tags: list[str]) -> DataFrame:
    tag = explode_packed(table(spark, sf_dir, "wikidata"), "scrape_id", ["instance_tag"], tags)
    country = table(spark, sf_dir, "idk2").where(F.length(F.regexp_replace("country", r"[\s ]", "")) > 0)
    return tag.select(F.lit("wikidata.instance_tag").alias("field"), F.col("scrape_id").alias("row_id"), "pos", "value").unionByName(country.select(F.lit("idk2.country").alias("field"), "row_id", F.lit(1).alias("pos"), F.col("country").alias("value")))


def p7_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its canonical entry ('' where it means none) and whether it was written as the entry is.

    Values written as an entry meet a broadcast list; the others are mapped once each, and rows of a heavy value aren't shuffled."""
    found = _matchers(spark, sf_dir)
    rows = _typed(spark, sf_dir, found["wikidata.instance_tag"][1])
    parts = []
    for field, (matcher, entries) in found.items():
        own = rows.where(F.col("field") == field)
        exact = bounded_table(spark.createDataFrame([(e, matcher.raw[e]) for e in entries], "value string, canonical string").dropDuplicates(["value"]), canonical.MAX_ENTRIES, "the canonical list")
        written = own.join(exact, "value").withColumn("as_written", F.lit(True))
        other = own.join(exact.select("value"), "value", "left_anti")
        mapped = cut_lineage(canonical.map_values(other.select("value"), matcher))
        parts += [written, join_counted(other, mapped, ["value"]).withColumn("as_written", F.lit(False))]
    return reduce(DataFrame.unionByName, [p.select("field", "row_id", "pos", "value", "canonical", "as_written") for p in parts])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_map(spark, sf_dir).where("not as_written").select("field", "row_id", "pos", "canonical")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_map(spark, sf_dir).where("canonical = ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing has to cut."""
    return packing.pack(_sizes(spark, sf_dir), "doc_id", "n_tokens").where("piece = 1").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), "doc_id", "n_tokens")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers get, by plan."""
    sizes = _sizes(spark, sf_dir)
    one = lambda planner: packing.fill_report(packing.pack(sizes, "doc_id", "n_tokens", planner=planner)).select(F.lit(planner.__name__).alias("plan"), "*")
    return reduce(DataFrame.unionByName, map(one, (packing.filled_buckets, packing.length_buckets, packing.best_fit)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that stay short although the mix uses all that their source has."""
    return p9_report(spark, sf_dir).where("short and reached_tokens = available_tokens * max_repeat").select("mix_id", "source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(quality.prose_distances(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), "doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's statistics, its distance from prose and each statistic's part in it."""
    return quality.prose_distances(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").drop("kind")


QUERIES = {f.__name__: f for f in (p1_found, p1_sample, p1_report, p5_found, p5_terms, p6_found, p6_split, p6_report, p7_found, p7_map, p7_unmatched, p8_found, p8_containers, p8_report, p9_found, p9_mix, p9_report, p10_found, p10_statistics)}

SQL = {
    "p6_found": """
        WITH RECURSIVE d AS (SELECT DISTINCT landmark_id AS l, regexp_extract(lower(id), '([0-9a-f]{16})', 1) AS image FROM datasplit WHERE landmark_id IS NOT NULL AND regexp_matches(lower(id), '[0-9a-f]{16}')),
        e AS (SELECT DISTINCT x.l AS a, y.l AS b FROM d x JOIN d y ON x.image = y.image AND x.l <> y.l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT a AS landmark_id_1, b AS landmark_id_2 FROM r WHERE a < b""",
    "p1_report": """
        WITH long AS (
            SELECT id, 'category' AS field_name, lower(trim(category, ' ')) AS label FROM image_pool
            UNION ALL SELECT id, 'continent', lower(trim(continent, ' ')) FROM image_pool
            UNION ALL SELECT id, 'country', lower(trim(country, ' ')) FROM image_pool),
        c AS (SELECT field_name, label, count(DISTINCT id) AS available FROM long GROUP BY 1, 2),
        n AS (SELECT count(DISTINCT id) AS n FROM image_pool),
        t AS (SELECT t.plan_id, t.field_name, t.field_value, greatest(t.min_rows, t.target_share * t.sample_fraction * n.n) AS wanted, coalesce(c.available, 0) AS available
              FROM sample_target t CROSS JOIN n LEFT JOIN c ON c.field_name = t.field_name AND c.label = lower(trim(t.field_value, ' '))),
        d AS (SELECT *, CAST(least(ceil(wanted - 1e-9), available) AS BIGINT) AS drawn FROM t)
        SELECT *, drawn / nullif(sum(drawn) OVER (PARTITION BY plan_id), 0) AS share, wanted <= available AS met FROM d""",
    "p1_found": """
        WITH long AS (
            SELECT id, 'category' AS field_name, lower(trim(category, ' ')) AS label FROM image_pool
            UNION ALL SELECT id, 'continent', lower(trim(continent, ' ')) FROM image_pool
            UNION ALL SELECT id, 'country', lower(trim(country, ' ')) FROM image_pool),
        c AS (SELECT field_name, label, count(DISTINCT id) AS available FROM long GROUP BY 1, 2),
        n AS (SELECT count(DISTINCT id) AS n FROM image_pool)
        SELECT t.plan_id, t.field_name, t.field_value
        FROM sample_target t CROSS JOIN n LEFT JOIN c ON c.field_name = t.field_name AND c.label = lower(trim(t.field_value, ' '))
        WHERE greatest(t.min_rows, t.target_share * t.sample_fraction * n.n) > coalesce(c.available, 0)""",
}
