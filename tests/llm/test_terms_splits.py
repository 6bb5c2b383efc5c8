import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import grouped_splits as g
from waymark.llm import terms
from waymark.operators.packed import split_packed
import pyarrow as pa


def test_terms_against_counter(spark):
    r = random.Random(3)
    words = ["Tower", " gate ", "mill/forge", "x" * 200, "é", "TOWER"]
    rows = [None if r.random() < 0.1 else "; ".join(r.choice(words) for _ in range(r.randrange(0, 5))) for _ in range(700)] + ["once,twice", "twice", ""]
    df = spark.createDataFrame([(x, 1) for x in rows], "term string, records int")
    parent, _, values = split_packed(pa.array(rows))
    low = [v.lower().strip() for v in values.to_pylist()]
    occurrences, records = Counter(low), Counter(t for _, t in set(zip(parent.tolist(), low)))
    holding = len(set(parent.tolist()))
    got = {x["term"]: x for x in terms.term_frequencies(terms.packed_term_counts(df, "term"), "f").collect()}
    assert {t: (x["occurrences"], x["records"]) for t, x in got.items()} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert {t: x["mark"] for t, x in got.items()} == {t: "rare" if records[t] <= 2 else "common" if records[t] > 0.1 * holding else None for t in records}
    plain = {x["term"]: x["records"] for x in terms.term_frequencies(terms.plain_term_counts(spark.createDataFrame([("A",), (" a",), ("a ",), (None,), ("  ",)], "v string"), "v"), "f").collect()}
    assert plain == {"a": 3}
    assert terms.term_frequencies(terms.packed_term_counts(df.limit(0), "term"), "f").count() == 0


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(("r", a))] = find(("e", b))
    groups = {}
    for a, _ in pairs:
        groups.setdefault(find(("r", a)), set()).add(a)
    return [s for s in groups.values() if len(s) > 1]


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(10_000)) for _ in range(500)] + [(i, 50_000 + i // 2) for i in range(1000, 1040)] + [(i, 60_000 + (i + 1) // 2) for i in range(1000, 1040)]
    pairs += [(7000 + i, 70_000) for i in range(60)]
    rows = spark.createDataFrame([*pairs, *pairs[:50], (None, 5), (3, None)], "a bigint, b bigint").repartition(4)
    want = brute(pairs)
    got = {}
    for x in g.record_components(rows, F.col("a"), F.col("b")).collect():
        got.setdefault(x["component"], set()).add(x["record"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and all(k == min(v) for k, v in got.items())
    assert max(map(len, want)) >= 40
    n = g.linked_pairs(rows, F.col("a"), F.col("b"))
    assert n.count() == sum(len(s) * (len(s) - 1) // 2 for s in want) and n.where("record_1 >= record_2").count() == 0
    assert g.linked_pairs(rows.limit(0), F.col("a"), F.col("b")).count() == 0


def test_image_key(spark):
    names = ["e9b73e34affc0187", " E9B73E34AFFC0187 ", "train/e/b/e9b73e34affc0187.jpg", "E9B73E34AFFC0187.JPG", "short", "", None, "e9b73e34affc01871"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(g.image_key("n")).collect()]
    assert len(set(got[:4])) == 1 and got[0] is not None and got[4:] == [None] * 4


def test_assignment(spark):
    r = random.Random(6)
    rows = []
    for i in range(6000):
        land = 1 if r.random() < 0.35 else None if r.random() < 0.03 else r.randrange(2, 900)
        rows.append((i, land, None if r.random() < 0.02 else r.randrange(20_000), r.choice(["x", "x", "y", None])))
    df = spark.createDataFrame(rows, "k bigint, land bigint, image bigint, label string").repartition(5)
    members = g.row_groups(df, "k", "land", F.col("image"), F.col("label"))
    assert members.count() == len(rows)
    split = g.assign_groups(members)
    assert split.groupBy("kind", "grp").count().where("count > 1").count() == 0
    placed = {x["key"]: x["split"] for x in members.join(split, ["kind", "grp"]).collect()}
    assert len(placed) == len(rows)
    for what in (1, 2):
        seen = {}
        for row in rows:
            if row[what] is not None:
                seen.setdefault(row[what], set()).add(placed[row[0]])
        assert all(len(s) == 1 for s in seen.values())
    n = Counter(placed.values())
    assert abs(n["train"] / 6000 - 0.8) < 0.03 and abs(n["val"] / 6000 - 0.1) < 0.03
    empty = g.row_groups(df.limit(0), "k", "land", F.col("image"), F.col("label"))
    assert g.assign_groups(empty).count() == 0


def test_shares_of_strata_meet_what_is_open():
    counts = np.array([[60.0, 20, 0], [10, 50, 5], [0, 0, 30]])
    for shares in ([0.8, 0.1, 0.1], [0.5, 0.3, 0.2]):
        open_ = np.outer(shares, counts.sum(axis=0))
        x = g.shares_of_strata(counts, open_)
        assert np.allclose(x.sum(axis=0), 1) and np.allclose(x @ counts, open_, atol=1e-6)
    skewed = np.outer([0.8, 0.1, 0.1], counts.sum(axis=0)) - np.array([[12.0, 0, 0], [0, 0, 0], [0, 0, 0]])  # a large group took some
    assert np.abs(g.shares_of_strata(counts, skewed) @ counts - skewed / skewed.sum(axis=0) * counts.sum(axis=0)).max() < 0.5
    assert np.allclose(g.shares_of_strata(np.zeros((2, 2)), np.zeros((3, 2))).sum(axis=0), 1)


def test_one_group_and_no_record_hold_most_rows(spark):
    rows = [(i, 1 if i % 2 else None, None if i % 3 else i % 40, "x" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, land bigint, image bigint, label string").repartition(4)
    members = g.row_groups(df, "k", "land", F.col("image"), F.col("label"))
    placed = {r["key"]: r["split"] for r in g.split_rows(members).collect()}
    assert len(placed) == 3000 and len({placed[k] for k, land, _, _ in rows if land == 1}) == 1
    for image in range(40):
        assert len({placed[k] for k, _, i, _ in rows if i == image}) <= 1
