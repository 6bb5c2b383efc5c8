"""Null keys, heavy groups, ties and empty tables of the operators that spread their groups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from waymark.functions import text, urls
from waymark.operators import query_sets, relational, samplers, splits


def test_ranked_as_one_window_would(spark):
    rows = [(i, None if i % 4 == 0 else "hot" if i % 4 < 3 else f"g{i % 9}") for i in range(900)]
    df = spark.createDataFrame(rows, "k int, g string").repartition(5)
    got = {r["k"]: (r["rank"], r["group_size"]) for r in relational.ranked(df, ["g"], splits.shuffled("k", 1), "k", digits=1).collect()}
    groups = {}
    for k, g in rows:
        groups.setdefault(g, []).append(k)
    want = {k: (n + 1, len(ks)) for ks in groups.values() for n, k in enumerate(sorted(ks, key=lambda k: (hashlib.md5(f"1|{k}".encode()).hexdigest(), k)))}
    assert got == want and relational.ranked(df.limit(0), ["g"], splits.shuffled("k", 1), "k").count() == 0


def test_running_totals(spark):
    rows = [(i % 50, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(6)
    upto = 0
    for n, r in enumerate(relational.running_totals(df, [F.col("a").desc(), F.col("b").asc()], "v").orderBy("number").collect()):
        upto += r["v"]
        assert (r["upto"], r["number"], r["total"]) == (upto, n + 1, sum(v for *_, v in rows))
    assert relational.running_totals(df.limit(0), [F.col("a").asc()], "v").count() == 0


def test_picks_with_null_keys_and_ties(spark):
    df = spark.createDataFrame([(None, 1, "e", None), (None, 2, None, "a"), ("u", 3, "", "b"), ("u", 4, "x", "c"), ("v", 5, "x", None), ("v", None, "y", "d")], "u string, n int, e string, extra string")
    assert sorted((str(r["u"]), r["n"], r["extra"]) for r in relational.last_success(df, "u", "e", ["n"]).collect()) == [("None", 2, "a"), ("u", 3, "b"), ("v", 5, None)]
    assert sorted((str(r["u"]), r["n"]) for r in relational.keep_first(df.where("n is not null"), ["u"], ["n"]).collect()) == [("None", 1), ("u", 3), ("v", 5)]
    assert relational.keep_first(df, ["u"], ["n"]).columns == df.columns
    lists = spark.createDataFrame([(["a", "b", "a"],), (None,), ([],), ([None],)], "x array<string>")
    assert {r["value"]: r["n"] for r in relational.element_counts(lists, "x").collect()} == {"a": 2, "b": 1, None: 3}


def test_splits_by_label_and_chance(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"l{i % 3}") for i in range(1000)], "k int, l string")
    got = splits.stratified_random_split(df, "k", "l").groupBy("l", "split").count().collect()
    n = {(r["l"], r["split"]): r["count"] for r in got}
    for label in (None, "l0", "l1", "l2"):
        whole = sum(v for (x, _), v in n.items() if x == label)
        test = round(0.2 * whole)
        assert n[label, "test"] == test and n[label, "val"] == round(0.3 * (whole - test))


def test_pairs_of_a_heavy_cell(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else f"c{i}") for i in range(500)], "k int, c string").repartition(4)
    got = samplers.pair_batches(df, "k", ["c"], 4, cap=20, drop_last=False).collect()
    assert len(got) == 20 and len({x for r in got for x in (r["first"], r["second"])}) == 40


def test_long_lists_are_an_error_and_rows_are_not(spark, monkeypatch):
    monkeypatch.setattr(query_sets, "MAX_LIST", 50)
    df = spark.createDataFrame([(i, "tower", "here" if i % 5 else None) for i in range(100)], "row_idx bigint, category string, place string")
    with pytest.raises(ValueError, match="80 entries"):
        query_sets.build_queries(df, "country", "place")
    long = query_sets.ground_truth(df, "country", "place").collect()
    assert sorted(r["row_idx"] for r in long) == [i for i in range(100) if i % 5] and {(r["n_relevant"], r["stratify_key"]) for r in long} == {(80, "tower|here")}
    assert query_sets.ground_truth(df.limit(0), "country", "place").count() == 0


def test_entities_aliases_and_links(spark):
    docs = [
        ('{"entities":{"Q1":{"labels":{"en":{"value":"Mill"},"fr":{"value":"Moulin"}},"aliases":{"en":[{"value":"Old mill"}],"de":[{"value":"M"}]},"claims":{"P10689":[{"mainsnak":{"datavalue":{"value":"7"}}}],"P402":[{"mainsnak":{}}]}}}}', "Q1"),
        ('{"entities":{"Q1":{}}}', "Q1"), ('{"entities":{"Q1":{}}}', "Q2"), ("not json", "Q1"), (None, "Q1"), ("{}", None),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "i int, d string, q string").select("i", text.parse_entity(F.col("d"), F.col("q")).alias("e"))
    got = {r["i"]: (r["n"], r["p"]) for r in df.select("i", text.entity_names(F.col("e")).alias("n"), text.entity_place(F.col("e")).alias("p")).collect()}
    assert got[0] == ({"en": ["Mill", "Old mill"], "fr": ["Moulin"], "de": ["M"]}, "way/7") and all(got[i] == (None, None) for i in range(1, 6))
    names = spark.createDataFrame([("Viet Nam",), ("Russian Federation",), ("Peru",), (None,)], "c string").select(text.common_country(F.col("c")).alias("c"))
    assert [r["c"] for r in names.collect()] == ["Vietnam", "Russia", "Peru", None]
    links = spark.createDataFrame([("https://geo.example/x?params=1",), ("https://GEO.example/x",), ("https://other/?params=geo.example",), (None,)], "u string")
    assert [r[0] for r in links.select(urls.is_geo_link(F.col("u"), ("geo.example",))).collect()] == [True, False, False, False]
