"""Train, validation and test splits that keep related records together.

Records and entities form a bipartite graph. Each entity first takes the smallest record group it occurs in, which leaves links
between record groups only; smallest labels then spread over the links, with a jump to the label's own label each round, until
nothing changes. Lineage is cut each round in the shared checkpoint folder. Links and labels never leave the executors.

Whole groups are assigned so that every split comes near its share of every label. Groups of more than 1/1000 of all rows (at
most 1000, so they fit the driver) go one by one, by size, to the split whose label counts they bring closest to its targets. The
others are strata by their most frequent label; a stratum's groups divide among the splits by hash thresholds, and the shares of
all strata are fitted together, from the counts of every label in every stratum, to what the large groups left open. Labels of
fewer than 1/200 of all rows, of which there may be any number, count as one label, so there are at most 201 strata.

Rows of heavy records, entities and groups meet a broadcast list of those; only the rows of light ones are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.thresholds import budget_thresholds, hash_of
from waymark.runtime import bounded_rows, bounded_table, cut_lineage, join_counted

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
SEED = 5
LARGE = 1 / 1000
MAX_LABELS = 200
RARE = ""  # the stratum of all rarer labels; that of a frequent label is "=" and the label


def image_key(c: str) -> Column:
    """The 16 hex digits of an image name as a number, null where there are none; case, paths, endings and blanks don't count."""
    digits = F.regexp_extract(F.lower(F.col(c)), r"(?<![0-9a-f])([0-9a-f]{16})(?![0-9a-f])", 1)
    return F.conv(F.nullif(digits, F.lit("")), 16, -10).cast("bigint")


def shared_entities(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs: record, entity. (distinct pairs, per entity its smallest record and whether it has others)."""
    pairs = pairs.where("record is not null and entity is not null").distinct()
    return pairs, pairs.groupBy("entity").agg(F.min("record").alias("least"), F.max("record").alias("most"))


def components(links: DataFrame) -> DataFrame:
    """links: a, b (a <> b). (record, component) of every linked record; a component is named by its smallest record."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("record")).agg(F.min("b").alias("m")).select("record", F.least("record", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.record).groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(near, labels.record == near.a, "left").select("record", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = spread.select(F.col("record").alias("at"), F.col("component").alias("above"))
        jumped = spread.join(up, spread.component == up.at, "left").select("record", "old", F.least("component", "above").alias("component"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("record", "component")
        if not jumped.where("old <> component").limit(1).count():
            return labels


def linked_components(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(record, component) of the records that share an entity with another, directly or through a chain."""
    links = pairs.join(least.where("least < most").select("entity", "least"), "entity").where("record <> least").select(F.col("record").alias("a"), F.col("least").alias("b"))
    return components(links)


def record_components(rows: DataFrame, record: Column, entity: Column) -> DataFrame:
    return linked_components(*shared_entities(rows.select(record.alias("record"), entity.alias("entity"))))


def linked_pairs(rows: DataFrame, record: Column, entity: Column) -> DataFrame:
    """(record_1, record_2), smaller first: all pairs of different records in one component. The pairs are the result asked for."""
    c = cut_lineage(record_components(rows, record, entity))
    one, two = c.select("component", F.col("record").alias("record_1")), c.select("component", F.col("record").alias("record_2"))
    return one.join(two, "component").where("record_1 < record_2").select("record_1", "record_2")


def row_groups(rows: DataFrame, key: str, record: str, entity: Column, label: Column) -> DataFrame:
    """(key, kind, grp, label) of every row. kind 0: grp is the record's component; 1: rows without a record whose entity no
    record has stay together by entity; 2: rows with neither stand alone."""
    base = rows.select(F.col(key).alias("key"), F.col(record).alias("record"), entity.alias("entity"), F.coalesce(label, F.lit("")).alias("label"))
    pairs, home = shared_entities(base.select("record", "entity"))
    pairs, home = cut_lineage(pairs), cut_lineage(home)
    known, lost = base.where("record is not null"), base.where("record is null")
    found = join_counted(lost, lost.where("entity is not null").groupBy("entity").agg(F.count("*").alias("n")).join(home.select("entity", "least"), "entity"), ["entity"])
    every = known.unionByName(found.select("key", F.col("least").alias("record"), "entity", "label"))
    comp = linked_components(pairs, home)
    sizes = every.where("record is not null").groupBy("record").agg(F.count("*").alias("n")).join(comp, "record")
    placed = join_counted(every, cut_lineage(sizes), ["record"])
    return placed.select("key", "label", F.when(F.col("record").isNotNull(), 0).when(F.col("entity").isNotNull(), 1).otherwise(2).alias("kind"), F.coalesce("component", "record", "entity", "key").alias("grp"))


def shares_of_strata(counts: np.ndarray, open_: np.ndarray, rounds: int = 200) -> np.ndarray:
    """counts: rows of each label (column) in each stratum (row). open_: rows of each label (column) that each split (row) takes.

    Shares of the splits (rows) in each stratum (column), adding up to 1, whose label counts come nearest to open_, by repeated
    scaling; a stratum of one label gets that label's shares at once."""
    whole = np.maximum(1e-9, open_.sum(axis=0))
    wanted = open_ / whole * counts.sum(axis=0)  # the same proportions of what there is
    x = np.where(counts.sum(axis=1) > 0, (open_ / whole) @ (counts / np.maximum(1e-9, counts.sum(axis=1, keepdims=True))).T, 0)
    x = np.where(x.sum(axis=0) > 0, x, 1)
    x /= x.sum(axis=0)
    for _ in range(rounds):
        reached = x @ counts
        x = x * ((wanted / np.maximum(1e-9, reached)) @ counts.T) / np.maximum(1e-9, counts.sum(axis=1))
        x = np.where(x.sum(axis=0) > 0, x, 1)
        x /= x.sum(axis=0)
    return x


def assign_groups(members: DataFrame, shares: Sequence[tuple[str, float]] = SPLITS, seed: int = SEED) -> DataFrame:
    """(kind, grp, split, n) of all groups, n rows each. members: kind, grp, label. An empty table has no groups."""
    spark = members.sparkSession
    everything = members.count()
    frequent = bounded_rows(members.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") * MAX_LABELS >= everything), MAX_LABELS, "the list of frequent labels")
    names = spark.createDataFrame([(r["label"], f"={r['label']}") for r in frequent], "label string, named string")
    folded = members.join(F.broadcast(names), "label", "left").select("kind", "grp", F.coalesce("named", F.lit(RARE)).alias("label"))
    counts = folded.groupBy("kind", "grp", "label").agg(F.count("*").alias("n"))
    per_group = F.struct(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("stratum"))
    groups = cut_lineage(counts.groupBy("kind", "grp").agg(per_group.alias("g"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels")).select("kind", "grp", "g.*", "labels"))
    large = F.col("size") > F.lit(LARGE * everything)
    by_label = groups.where(~large).select("stratum", F.explode("labels").alias("label", "n")).groupBy("stratum", "label").agg(F.sum("n").alias("n"))
    matrix = bounded_rows(by_label, (MAX_LABELS + 1) ** 2, "the label counts of the strata")
    big = bounded_rows(groups.where(large).select("kind", "grp", "size", "labels").orderBy(F.col("size").desc(), "kind", "grp"), int(1 / LARGE), "the list of large groups")
    labels = sorted({r["label"] for r in matrix} | {x for r in big for x in r["labels"]})
    at = {x: i for i, x in enumerate(labels)}
    strata = np.zeros((len(labels), len(labels)))
    for r in matrix:
        strata[at[r["stratum"]], at[r["label"]]] = r["n"]
    total = strata.sum(axis=0)
    vectors = []
    for r in big:
        v = np.zeros(len(labels))
        for x, n in r["labels"].items():
            v[at[x]] = n
        vectors.append(v)
        total = total + v
    want = np.outer([s for _, s in shares], total)
    have = np.zeros_like(want)
    chosen = []
    for r, v in zip(big, vectors):
        cost = [(((have[k] + v - want[k]) ** 2 - (have[k] - want[k]) ** 2) / np.maximum(1, want[k])).sum() for k in range(len(shares))]
        k = int(np.argmin(cost))
        have[k] += v
        chosen.append((r["kind"], r["grp"], shares[k][0], r["size"]))
    upto = np.cumsum(shares_of_strata(strata, np.maximum(0, want - have)), axis=0)
    mass = strata.sum(axis=1)
    small = groups.where(~large).select("kind", "grp", "size", "stratum", hash_of(F.struct("kind", "grp"), seed).alias("h"))
    budgets = spark.createDataFrame([(k, x, float(upto[k, at[x]] * mass[at[x]])) for k in range(len(shares) - 1) for x in labels if mass[at[x]]], "plan int, g string, budget double")
    cut = budget_thresholds(small.select(F.col("stratum").alias("g"), "h", "size"), budgets)
    wide = cut.groupBy(F.col("g").alias("stratum")).agg(*[F.max(F.when(F.col("plan") == k, F.coalesce("tau", F.lit(2**63 - 1)))).alias(f"t{k}") for k in range(len(shares) - 1)])
    split = F.coalesce(*[F.when(F.col("h") <= F.col(f"t{k}"), F.lit(shares[k][0])) for k in range(len(shares) - 1)], F.lit(shares[-1][0]))
    rest = small.join(bounded_table(wide, MAX_LABELS + 1, "the list of strata"), "stratum").select("kind", "grp", split.alias("split"), F.col("size").alias("n"))
    return rest.unionByName(spark.createDataFrame(chosen, rest.schema))


def split_rows(members: DataFrame, shares: Sequence[tuple[str, float]] = SPLITS, seed: int = SEED) -> DataFrame:
    """members (kind, grp, label and more, cheap to read) with the split of each row's group."""
    return join_counted(members, cut_lineage(assign_groups(members, shares, seed)), ["kind", "grp"])
